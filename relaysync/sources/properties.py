"""Properties source (A4): properties files -> (key, value) DataFrame.

Files are read by Spark; later files override earlier ones (explicit config
over default file), missing files are skipped.  Lines follow the usual
properties-file format (see ``read_properties``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.settings import KNOWN_KEYS, Settings

# A comment line (a backslash does not continue it), or a logical line: plain
# characters, continued line ends and escaped characters.
LINE = r"(?:[ \t\f]*[#!][^\r\n]*)|(?:[^\\\r\n]++|\\\r?\n|\\.)+"
CONTINUATION = r"\\\r?\n[ \t\f]*"
# A run of unicode escapes: characters of one unit, or pairs of surrogates.
UNICODE = r"(?:\\u(?![dD][89abAB])(?![dD][c-fC-F])[0-9a-fA-F]{4}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})+"
ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\f": "\f"}


def _logical_lines(text):
    """Array of logical lines, comments among them; continuation lines are joined."""
    lines = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    return F.transform(lines, lambda x: F.regexp_replace(x, CONTINUATION, ""))


def _unescape(col):
    """Escapes of the properties format, undone in one pass from the left: \\t \\n \\r \\f,
    unicode escapes (half a surrogate pair, or fewer than four digits, is left as written), and
    backslash + char -> char."""
    def plain(token):
        code = F.decode(F.unhex(F.regexp_replace(token, r"\\u", "")), "UTF-16BE")
        out = F.when(token.rlike(f"^{UNICODE}$"), code).otherwise(F.regexp_replace(token, r"^\\([^u])", "$1"))
        for written, char in ESCAPES.items():
            out = F.when(token == written, F.lit(char)).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(col, F.lit(UNICODE + r"|\\.|[^\\]+"), F.lit(0)), plain), "")


def _text(spark: SparkSession, path: str) -> DataFrame | None:
    """The file as one row, or None when the session's file system does not have it."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_properties(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, value, priority) rows of every existing file; priority = file order.

    Properties-file rules: ``#`` / ``!`` comment lines, a trailing backslash
    continues a line, the key ends at the first unescaped ``=``, ``:`` or
    whitespace, whitespace around the separator is dropped, trailing
    whitespace of the value is kept.  Each (small) file is read whole.
    """
    frames = []
    for prio, path in enumerate(paths):
        text = _text(spark, path)
        if text is not None:
            frames.append(text.select(F.col("value").alias("text"), F.lit(prio).alias("priority")))
    if not frames:
        return spark.createDataFrame([], "key string, value string, priority int")
    texts = frames[0]
    for f in frames[1:]:
        texts = texts.unionByName(f)
    lines = texts.select(F.explode(_logical_lines(F.col("text"))).alias("line"), "priority").select(
        F.regexp_replace("line", r"^[ \t\f]+", "").alias("line"), "priority")
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("!"))
    raw_key = F.regexp_extract("line", r"^((?:\\.|[^=:\s\\])*)", 1)
    rest = F.substring(F.col("line"), F.length(raw_key) + 1, 1 << 30)
    raw_value = F.regexp_replace(rest, r"^[ \t\f]*[=:]?[ \t\f]*", "")
    return lines.select(_unescape(raw_key).alias("key"), _unescape(raw_value).alias("value"), "priority")


def resolve(props: DataFrame) -> DataFrame:
    """One value per key: the highest priority file wins."""
    return props.groupBy("key").agg(F.max_by("value", "priority").alias("value"))


def to_map(props: DataFrame, aliases: dict[str, str] | None = None) -> dict[str, str]:
    """The resolved properties that ``Settings`` reads, or that are renamed to one, as a driver dict
    (as many at most as there are such names, whatever the files hold)."""
    wanted = [*KNOWN_KEYS, *(aliases or {})]
    return {r["key"]: r["value"] for r in resolve(props.where(F.col("key").isin(wanted))).collect()}


def load_settings(spark: SparkSession, paths: list[str], aliases: dict[str, str] | None = None) -> Settings:
    return Settings.from_map(to_map(read_properties(spark, paths), aliases), aliases)
