"""License scans by canonical digest lookup.

A text's canonical form has one case, no punctuation, no copyright lines, list marks or title line and
one spelling of words that have several; its SHA-256 is looked up among the digests of known licences by a hash join. The
whole text is looked up, and so is each of its lines, where a licence notice may stand by itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.llm import common as C
from fleetstate.llm.license_texts import KNOWN

LAST = (1 << 63) - 1
BROADCAST_ROWS = 100_000  # digests and names of some 100 bytes: 10 MB at most

# in order, on lower-cased text; line breaks stay, as each line is looked up, too
_START = "(^|\\n)([^a-z0-9\\n]*)"
# what follows "copyright" where a wrapped text goes on at the start of a line, and no holder is named
_PLAIN = "(notices?|holders?|owners?|ownership|laws?|licen[cs]es?|interests?|statements?|permissions?|protection|treaty|treaties|disclaimers?|status|doctrines?|resulting|and|or|in|on|of|to|is|as|are|was|for|from|with|under|if|when|where|that|which|will|shall|may|the[ \\t]+(software|program|library|work))\\b"
_NO_NAME = (_START + "copyright([ \\t]+" + _PLAIN + "|[ \\t]*[,.;)])", "\\1\\2copyrightkept\\3")
_LINES = (_START + "((portions[ \\t]+)?(copyright[ \\t]*(\\(c\\)|\\x{A9}|[0-9<\\[])|\\(c\\)[ \\t]*(copyright|[0-9])|\\x{A9}|copyright([ \\t]*:|[ \\t])[ \\t]*[^\\x00-\\x20,.;:)])|spdx-filecopyrighttext|all rights reserved)[^\\n]*", "\\1")
# numbers and letters of a list: after the end of a clause or a blank line, so that "version 2." stays
_VERSION = ("([^a-z0-9]v(er|ers)?)\\.", "\\1")
_MARKS = ("(^|[.;:,][^a-z0-9]{0,40}[ \\t\\r\\n]((and|or)[ \\t\\r\\n]+)?|\\n[^a-z0-9\\n]{0,40}\\n[^a-z0-9]{0,40})\\(?([0-9][0-9]?|[a-z]|ii|iii|iv|vi|vii|viii|ix)[.)][ \\t\\r\\n]", "\\1")
_SIGNS = ("[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{A0}\\x{A9}\\x{2010}-\\x{2015}\\x{2018}-\\x{201F}\\x{2022}\\x{2026}]+", " ")
# a first line that is only the name of a short licence, whose text follows; no group repeats without a
# bound, as the JVM's engine takes a stack frame for each time
_TITLE = ("^[ \\n]*((the|mit|expat|x11|isc|zlib|libpng|bsd|0bsd|freebsd|new|modified|revised|simplified|or|zero|one|two|three|1|2|3|clause|style|licen[cs]e) ){0,12}(mit|expat|x11|isc|zlib|libpng|bsd|0bsd|licen[cs]e) *\\n[ \\n]*([a-z0-9])", "\\4")
_PATTERNS = [
    _NO_NAME,
    _LINES,
    ("copyrightkept", "copyright"),
    _VERSION,
    _MARKS,
    _SIGNS,
    _TITLE,
    ("([ \\n]non)[ \\n]+(commercial|infring)", "\\1\\2"),
    ("(copyright[ \\n]+)owner", "\\1holder"),
    ("is(e|ed|es|ing|er|ers|ation|ations)([ \\n]|$)", "iz\\1\\2"),
    ("([a-z][a-z])our(s|ed|able|ing|less)?([ \\n]|$)", "\\1or\\2\\3"),
]
_WORDS = [("licenc", "licens"), (" sub licens", " sublicens"),
          ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("https ", "http ")]


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, new in _PATTERNS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    for word, new in _WORDS:
        out = F.replace(out, F.lit(word), F.lit(new))
    return out


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, "[ \\n]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    rows = json.dumps([{"license_id": a, "text": b} for a, b in KNOWN])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<license_id: string, text: string>>")))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Append digest, license_id (of the whole text; null if unknown), notices (sorted licence ids of
    its lines) and n_notice_lines to the columns of ``docs``.

    Null and empty texts, and those of copyright lines and signs alone, have an empty canonical form
    and match nothing. Where several licences share a canonical text, their ids are joined by
    " OR ". Rows of one id are looked up each on its own. Columns of the appended names are replaced.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    names = known.select("license_id", one_line(canonical_lines(F.col("text"))).alias("form")).where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.array_join(F.sort_array(F.collect_set("license_id")), " OR ").alias("name"))
    names = C.cut(names)
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    text = F.col("text").cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    # a text's own digest (line 0) and its lines', from one pass over the text
    form = base.select("doc_key", "text_key", canonical_lines(F.col("text")).alias("form"))
    lines = F.transform(F.split("form", "\n"), lambda x: F.sha2(F.trim(x), 256))
    every = form.select("doc_key", "text_key", F.posexplode(F.concat(F.array(F.sha2(one_line(F.col("form")), 256)), lines)).alias("line", "digest"))
    whole, known_line = F.col("line") == 0, (F.col("line") > 0) & F.col("name").isNotNull()
    found = every.join(names, "digest", "left").groupBy("doc_key", "text_key").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("name"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(known_line, F.col("name")))).alias("notices"), F.collect_set(F.when(known_line, F.col("line"))).alias("at"))
    new = ["digest", "license_id", "notices", "n_notice_lines"]
    done = base.drop("text").join(found, ["doc_key", "text_key"])
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], "digest", "license_id", "notices", F.size("at").cast("long").alias("n_notice_lines"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"), "n_notice_lines")


def _sql_form(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in _PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    for word, new in _WORDS:
        out = f"replace({out}, '{word}', '{new}')"
    return out


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    whole = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT digest, string_agg(license_id, ' OR ' ORDER BY license_id) AS license_id FROM (SELECT DISTINCT license_id, sha256(form) AS digest FROM (SELECT license_id, {whole.format(_sql_form('text'))} AS form FROM (VALUES {rows}) v(license_id, text)) WHERE form <> '') GROUP BY digest),
f AS (SELECT doc_id, {_sql_form('text')} AS form FROM documents),
l AS (SELECT doc_id, line, sha256(trim(x)) AS digest FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS x FROM (SELECT doc_id, string_split(form, chr(10)) AS a FROM f))),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(DISTINCT line) AS n FROM l JOIN k ON k.digest = l.digest GROUP BY doc_id),
d AS (SELECT doc_id, sha256({whole.format('form')}) AS digest FROM f)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n, 0)::BIGINT AS n_notice_lines FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""


OP1_SQL = _sql()
