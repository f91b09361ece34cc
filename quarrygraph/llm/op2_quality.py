"""Quality rules over documents, built from DataFrame functions only.

Rules on one document are counted inside its row. The cross-document rule hashes normalised lines,
counts for each host the distinct documents that hold a line, removes the lines above the limits and
rejects documents of which too little is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import SPACE_PATTERN, SPACES, fresh, table, text_key

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line is removed on a host when more of its documents hold it than both limits allow: the share keeps copies
#: of a page on a large host apart from what its pages have in common, the count does so on a small host.
MAX_DOCS, MAX_SHARE = 10, 0.01
#: A document is depleted when less than this share of its line characters is left.
MIN_LEFT = 0.2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz000000000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def _shifted(hashes: Column, by: int) -> Column:
    """Hashes of runs twice as long: each hash with the one ``by`` places on. The tail is cut off later."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, F.greatest(F.size(hashes) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: each such window adds what the next one does not cover."""

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["h"] == F.get(s, i - 1)["h"], x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = _let(_let(placed, places), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tkey, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars), one row a row of ``docs``;
    ``chars`` is the length of its lines without white space at their ends. Null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.trim(text, F.lit(SPACES))
    found = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_PATTERN, -1))

    def of_words(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        eight = _let(_let(_let(one, lambda h: _shifted(h, 1)), lambda h: _shifted(h, 2)), lambda h: _shifted(h, 4))
        windows = F.when(F.size(w) > WINDOW, F.slice(eight, 1, F.size(w) - WINDOW + 1))
        repeated = _let(windows, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(_covered(h)))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated.alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")

    def of_lines(x: Column) -> Column:
        chars = F.aggregate(x, F.lit(0).cast("long"), lambda total, line: total + F.length(F.trim(line, F.lit(SPACES))))
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), chars.alias("chars"))

    counted = docs.select(
        F.col(id_col).alias("id"),
        text_key(F.col(text_col)).alias("tkey"),
        _let(found, of_words).alias("of_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, of_lines).alias("of_lines"),
    )
    return counted.select("id", "tkey", F.col("of_words.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("of_lines.n_dup_lines").alias("n_dup_lines"), F.col("of_words.n_repeat_words").alias("n_repeat_words"), F.col("of_lines.chars").alias("chars"))


def _line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), _UPPER, _LOWER)


def _line_hash(key: Column) -> Column:
    """128 bits of a normalised line."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(id, tkey, at, h, chars): every line that more documents of its host hold than both limits allow.

    A document is an id; of rows without an id, each different text is one. A null host is the host ''.
    Rows that repeat an id are told apart by ``tkey``, a hash of their text. Lines of white space are no lines.
    """
    tkey = text_key(F.col(text_col))
    own = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), tkey).alias("no_id"), tkey.alias("tkey"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = own.select("host", "id", "no_id", "tkey", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("key", _line_key(F.col("line"))).filter("key <> ''").select("host", "id", "no_id", "tkey", "at", _line_hash(F.col("key")).alias("h"), F.length("key").alias("chars"))
    held = lines.select("host", "h", "id", "no_id").distinct().groupBy("host", "h").agg(F.count("*").alias("held"))
    hosts = own.select("host", "id", "no_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    over = held.filter(F.col("held") > max_docs).join(hosts, "host").filter(F.col("held") > F.col("docs") * max_share)
    return lines.join(over.select("host", "h"), ["host", "h"]).select("id", "tkey", "at", "h", "chars")


def _removed(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, max_share: float) -> DataFrame:
    """(id2, tkey2, gone, lost, n_removed_lines) of each document that loses lines; ``gone`` holds their places."""
    found = frequent_lines(docs, id_col, host_col, text_col, max_docs, max_share)
    found = found.groupBy(F.col("id").alias("id2"), F.col("tkey").alias("tkey2")).agg(F.collect_set(F.struct("at", "chars")).alias("gone"))  # rows that repeat a document give the same places
    lost = F.aggregate("gone", F.lit(0).cast("long"), lambda total, x: total + x["chars"])
    return found.select("id2", "tkey2", F.transform("gone", lambda x: x["at"]).alias("gone"), lost.alias("lost"), F.size("gone").cast("long").alias("n_removed_lines"))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """All columns of ``docs``, the text without the lines above the limits. A null text stays null; repeated rows,
    null ids and hosts as in ``quality``; an empty table stays empty."""
    gone = _removed(docs, id_col, text_col, host_col, max_docs, max_share)
    tkey, gone_name = fresh([*docs.columns, "id2", "tkey2"], "tkey__", "gone__")
    keyed = docs.withColumn(tkey, text_key(F.col(text_col)))
    joined = keyed.join(gone.select("id2", "tkey2", F.col("gone").alias(gone_name)), keyed[id_col].eqNullSafe(gone["id2"]) & (keyed[tkey] == gone["tkey2"]), "left").drop(gone["id2"], gone["tkey2"])
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(gone_name, i))
    return joined.withColumn(text_col, F.when(F.col(gone_name).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(tkey, gone_name)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Counts and verdicts, one row for each row of ``docs``; ``without_frequent_lines`` gives the texts.

    Null texts have no words and fail the base rules. Rows that repeat an id are judged by their own
    text; rows that repeat both get the same result. Null ids and hosts are values like others.
    Extra columns are ignored; an empty table gives no rows.
    """
    base = document_rules(docs, id_col, text_col)
    lost = _removed(docs, id_col, text_col, host_col, max_docs, max_share).drop("gone")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = base.join(lost, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tkey") == F.col("tkey2")), "left").withColumn("base_failed", failed)
    depleted = F.coalesce(F.col("chars") - F.col("lost") < min_left * F.col("chars"), F.lit(False))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table. Odd rows as in ``quality``."""
    return quality(table(spark, sf_dir, "documents"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT win.doc_id, count(DISTINCT win.i + o.k) AS n FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) >= 2) g ON win.doc_id = g.doc_id AND win.s = g.s,
  (SELECT unnest(range(0, 8)) AS k) o GROUP BY win.doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (SELECT *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS k FROM l WHERE trim(line, {_WS}) <> ''),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l2 GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
over AS (SELECT l2.host, k FROM l2 JOIN hosts ON l2.host = hosts.host GROUP BY l2.host, k, docs HAVING count(DISTINCT l2.doc_id) > {MAX_DOCS} AND count(DISTINCT l2.doc_id) > docs * {MAX_SHARE}),
left_ AS (SELECT doc_id, sum(length(l2.k)) AS chars, sum(CASE WHEN over.k IS NULL THEN 0 ELSE length(l2.k) END) AS lost, count(over.k) AS n_lost FROM l2 LEFT JOIN over ON l2.host = over.host AND l2.k = over.k GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(left_.chars - left_.lost < {MIN_LEFT} * left_.chars, FALSE) AS poor, coalesce(left_.n_lost, 0) AS n_removed_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN dl ON w.doc_id = dl.doc_id LEFT JOIN left_ ON w.doc_id = left_.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT poor AS kept, n_removed_lines FROM c
"""
