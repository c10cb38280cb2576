"""Secret scans through a trigram inverted index, in DataFrame functions only.

trigram_query() derives from each rule's regular expression a Boolean query over trigrams (of ASCII lower case):
runs of literals must have all of theirs, alternatives any. The index holds, for every trigram that a rule asks for,
the rows whose lower-cased text has it; it is written to the shared folder. Postings are intersected per row,
and the regular expression verifies the rows that remain. Rules without a mandatory trigram scan every text.

Spans are code points, end exclusive, of the leftmost non-overlapping matches of each rule; spans that start alike
come in order of rule. Null texts are empty, very long ones are scanned whole. Rows are told apart by id and a
hash of the text; equal rows have equal spans. An empty table gives an empty result. Other columns of docs are
carried along by redact(), whatever their names, and not looked at.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, and the least length of a group (0: of the whole match) that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds; matches of fewer characters than asked are dropped.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")

#: A query is None (nothing is mandatory), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _both(op: str, queries: list) -> Query:
    if op == "or" and any(q is None for q in queries):
        return None
    found = list(dict.fromkeys(q for q in queries if q is not None))
    return (op, tuple(found)) if len(found) > 1 else found[0] if found else None


def _of_strings(strings: list[str]) -> Query:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str) -> Query:
    """What trigrams any match of pattern must hold, in lower case."""

    def walk(items) -> Query:
        found, runs = [], [""]

        def end() -> None:
            nonlocal runs
            found.append(_of_strings(runs))
            runs = [""]

        for op, arg in items:
            letters = None
            if op is sre.LITERAL:
                letters = [chr(arg).lower()]
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                letters = sorted({chr(a).lower() for _, a in arg})
            if letters and len(runs) * len(letters) <= 16:
                runs = [r + x for r in runs for x in letters]
            elif op is sre.SUBPATTERN:
                end()
                found.append(walk(arg[3]))
            elif op is sre.BRANCH:
                end()
                found.append(_both("or", [walk(x) for x in arg[1]]))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                end()
                found.append(walk(arg[2]))
            else:
                end()
        end()
        return _both("and", found)

    return walk(sre_parser.parse(pattern))


def _trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query: Query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, [_holds(q, present) for q in query[1]])


def _spans(rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches in text: the lengths between and of matches add up to positions."""
    text = F.col("text")
    gaps = F.split(text, rule.pattern, -1)
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    matches = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), (F.length(F.get(counted, i)) >= rule.least).alias("counts")))
    kind = "array<struct<start:int,rule:int,end:int>>"

    def step(acc, m):
        start = acc["at"] + m["gap"]
        end = start + m["size"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["counts"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(matches, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step, lambda acc: acc["found"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(kind))


def _row_of(text: Column) -> Column:
    """Tells a row apart: 64 bits of hash and the id."""
    return F.struct(F.xxhash64("doc_id", text).alias("hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """texts(row, text) to postings (trigram, row) of the given trigrams, written to the shared folder."""
    low = texts.select("row", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return materialize(low.select("row", F.explode(held).alias("trigram")), "postings")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) to row, doc_id and spans: start, rule (number) and end of every secret, by start and rule."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("row", _row_of(F.col("text")))
    asked = [(i, rule, trigram_query(rule.pattern)) for i, rule in enumerate(rules)]
    scanned = [_spans(rule, i) for i, rule, query in asked if query is None]
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    base = texts.select("row", "doc_id", F.concat(empty, *scanned).alias("scanned"))
    asked = [x for x in asked if x[2] is not None]
    if not asked:
        return base.select("row", "doc_id", F.array_sort("scanned").alias("spans"))
    postings = build_index(texts, sorted(set().union(*[_trigrams(q) for _, _, q in asked])))
    present = postings.groupBy("row").agg(F.collect_set("trigram").alias("present"))
    wanted = [_holds(q, F.col("present")) for _, _, q in asked]
    hits = present.select("row", *[w.alias(f"w{i}") for (i, _, _), w in zip(asked, wanted)]).where(reduce(Column.__or__, [F.col(f"w{i}") for i, _, _ in asked]))
    checked = F.concat(*[F.when(F.col(f"w{i}"), _spans(rule, i)).otherwise(empty) for i, rule, _ in asked])
    verified = texts.select("row", "text").join(hits, "row").select("row", checked.alias("checked")).where(F.size("checked") > 0).dropDuplicates(["row"])
    return base.join(verified, "row", "left").select("row", "doc_id", F.array_sort(F.concat("scanned", F.coalesce("checked", empty))).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; overlapping spans are one. Other columns are kept."""
    found = find_secrets(docs, rules).where(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"])
    text = F.coalesce("text", F.lit(""))
    both = docs.withColumn("_row_of_secrets", _row_of(text)).join(found.withColumnRenamed("row", "_row_of_secrets").withColumnRenamed("spans", "_spans_of_secrets"), "_row_of_secrets", "left")

    def step(acc, s):
        gap = F.when(s["start"] > acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        first = F.when((acc["at"] == 0) & (s["start"] == 0), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.coalesce(gap, first, F.lit(""))).alias("out"))

    clean = F.aggregate("_spans_of_secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return both.withColumn("text", F.when(F.col("_spans_of_secrets").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        F.sha2(told(F.filter("spans", lambda s: s["rule"] < len(BASE))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    start = "coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind, CAST({start} AS BIGINT) AS a, length(whole[i]) AS n
FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS part FROM d), unnest(range(1, len(whole) + 1)) u(i)
WHERE length(part[i]) >= {rule.least}"""


_SPANS_SQL = "coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rule) {}, '')"
OP1_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, sha256({_SPANS_SQL.format(f"FILTER (rule < {len(BASE)})")}) AS base_sha256, {_SPANS_SQL.format("")} AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
