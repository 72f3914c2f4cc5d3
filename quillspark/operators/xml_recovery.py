"""XML with missing, stray or crossed tags brought to a well-formed state, each document on its own row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

_PIECE = re.compile(r"<!--.*?-->|<[?!][^>]*>|<(/?)\s*([A-Za-z_][\w:.-]*)([^<>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+))""")
_STRAY = re.compile(r"&(?!(?:[A-Za-z]\w*|#[0-9]+|#x[0-9A-Fa-f]+);)")


def _tag(name: str, rest: str) -> str:
    values = {key: next(v for v in found if v is not None) for key, *found in ((m[1], m[2], m[3], m[4]) for m in _ATTRIBUTE.finditer(rest))}
    return name + "".join(f' {k}="{_STRAY.sub("&amp;", v).replace(chr(34), "&quot;")}"' for k, v in values.items())


def recovered(xml: str) -> str:
    """The document with every opened tag closed: a closing tag closes what is open inside it, one without an opening goes, what is open at the end is closed there. Attributes get double quotes, the last of equal ones wins; stray signs in texts are escaped."""
    out, stack = [], []
    for m in _PIECE.finditer(xml):
        piece, name = m[0], m[2]
        if name is None:
            out.append(piece if piece.startswith(("<!", "<?")) else _STRAY.sub("&amp;", piece).replace("<", "&lt;"))
        elif m[1]:
            if name in stack:
                while True:
                    out.append(f"</{stack[-1]}>")
                    if stack.pop() == name:
                        break
        elif m[3].rstrip().endswith("/"):
            out.append(f"<{_tag(name, m[3])}/>")
        else:
            out.append(f"<{_tag(name, m[3])}>")
            stack.append(name)
    return "".join(out + [f"</{name}>" for name in reversed(stack)])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else recovered(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "xml"])


def recover_xml(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """Rows (id, xml) with ``recovered`` documents; null stays null, an empty document is empty, repeated rows come out as often as they come in."""
    src = df.select(F.col(id_col).alias("id"), F.col(xml_col).cast("string").alias("xml"))
    kind = src.schema["id"].dataType.simpleString()
    return spread(src, "id").mapInArrow(_batches, f"id {kind}, xml string").select(F.col("id").alias(id_col), F.col("xml").alias(xml_col))
