"""N-Triples and N-Quads: splittable text, parsed by Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SUBJECT = r"(?:<([^>]*)>|(_:[^\s]+))"
#: Possessive, so that Java's matcher needs no stack for the characters of a long literal.
_OBJECT = r'(?:<([^>]*)>|(_:[^\s]+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_GRAPH = r"(?:\s+(?:<[^>]*>|_:[^\s]+))?"
LINE = rf"^\s*{_SUBJECT}\s+<([^>]*)>\s+{_OBJECT}{_GRAPH}\s*\.\s*(?:#.*)?$"

_MARK = "\u0001"

#: Escapes of one character (fixed values of the format).
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: Column) -> Column:
    """Escapes of characters and of code points resolved."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    table = F.create_map(*[x for k, v in ESCAPES.items() for x in (F.lit(k), F.lit(v))])

    def one(piece: Column) -> Column:
        kind, code = F.substring(piece, 2, 1), F.substr(piece, F.lit(3))
        # A code point as UTF-32, which Spark can decode.
        point = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(~piece.startswith("\\"), piece).when(kind.isin("u", "U") & (F.length(piece) > 2), point).otherwise(F.coalesce(F.element_at(table, kind), kind))

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``s, p, o`` of a file or folder; terms are their text alone, without datatype, language or graph.

    Empty lines and comments go; ``strict`` makes another line that doesn't
    parse an error, else it goes too.
    """
    # One pass of the pattern for all parts of a line, which a mark parts; lines that hold the mark themselves take one for each.
    marked = F.regexp_replace("value", LINE, f"$1$2{_MARK}$3{_MARK}$4$5$6{_MARK}")
    apart = F.transform(F.array(F.lit("$1$2"), F.lit("$3"), F.lit("$4$5$6")), lambda x: F.regexp_replace(F.col("value"), F.lit(LINE), x))
    odd = F.col("value").contains(_MARK)
    parts = F.when(~odd, F.split(marked, _MARK)).when(F.col("value").rlike(LINE), apart).otherwise(F.array("value"))
    lines = spark.read.text(path).select("value", parts.alias("parts"))
    lines = lines.where((F.size("parts") > 1) | ~F.col("value").rlike("^\\s*(#.*)?$"))
    good = F.size("parts") > 1
    if strict:
        lines = lines.where(F.assert_true(good, F.concat(F.lit("not a triple: "), F.col("value"))).isNull())
    else:
        lines = lines.where(good)
    return lines.select(*[unescape(F.col("parts")[i]).alias(c) for i, c in enumerate(("s", "p", "o"))])


def write(triples: DataFrame, path: str) -> None:
    """N-Triples; objects that look like IRIs or blank nodes are written as such, all others as literals."""

    def quoted(text: Column) -> Column:
        for char, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return F.concat(F.lit('"'), text, F.lit('"'))

    def iri(text: Column) -> Column:
        return F.when(text.startswith("_:"), text).otherwise(F.concat(F.lit("<"), text, F.lit(">")))

    is_iri = F.col("o").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"]*|_:\S+)$")
    line = F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(is_iri, iri(F.col("o"))).otherwise(quoted(F.col("o"))), F.lit("."))
    triples.select(line.alias("value")).write.text(path)
