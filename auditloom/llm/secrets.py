"""Secret scanning with a trigram inverted index, in DataFrame functions only.

1. From each rule's regular expression a Boolean trigram query is derived.
2. The index holds a posting (trigram, document) for every trigram that some
   rule asks for.
3. Postings are counted per document and branch; a document that has all
   trigrams of a branch is a candidate of the branch's rule.
4. Candidates are verified with the rule's expression. Rules without mandatory
   trigrams scan every text.

Spans come from the engine's own matcher: splitting a text at an expression and
extracting its matches give the same leftmost, non-overlapping matches, and the
lengths of the pieces give their places in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import docs_of, read
from auditloom.llm.trigrams import derive


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The contract's three kinds in its order, then added kinds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),  # the runs of [0-9a-f]+ that have 32 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches, in code points, end exclusive."""
    found, pieces = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(
        F.transform(F.slice(pieces, F.lit(1), F.size(found)), F.length).alias("gap"),
        F.transform(found, F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("own"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]
        own = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc) for each of ``grams`` in the lower-cased text of each document."""
    wanted = F.array(*[F.lit(g) for g in grams])
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda g: F.contains(low, g)))[0]
    return docs.select(F.explode(held).alias("gram"), F.col("doc"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, rules): the rules of which a document has all trigrams of some branch."""
    spark = docs.sparkSession
    asked = [(gram, f"{i}.{j}", i, len(branch)) for i, rule in enumerate(rules) for j, branch in enumerate(derive(rule.pattern)) for gram in sorted(branch)]
    query = spark.createDataFrame(asked, "gram string, branch string, rule int, need int")  # as many rows as the rules have trigrams
    index = postings(docs, sorted({a[0] for a in asked}))
    met = index.join(F.broadcast(query), "gram").groupBy("doc", "branch", "rule").agg(F.count_distinct("gram").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").groupBy("doc").agg(F.collect_set("rule").alias("rules"))  # no more than there are rules


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text, found``: all spans of each document, by start and then by the order of the rules.

    Null texts are empty and have no spans; rows that repeat a doc_id are
    scanned each for itself; documents without doc_id are kept.
    """
    return _joined(docs_of(docs), rules).select("doc_id", "text", "found")


def _joined(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` with their spans in ``found``. Rows meet their candidates by a hash of doc_id and text, which no
    missing or repeated doc_id makes hot; a clash only has a text scanned in vain."""
    keyed = rows.withColumn("doc", F.xxhash64("doc_id", "text"))
    indexed = [i for i, rule in enumerate(rules) if derive(rule.pattern)]
    joined = keyed.join(candidates(keyed, rules), "doc", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = []
    for i, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, i)
        found.append(F.when(F.array_contains("rules", i), spans).otherwise(none) if i in indexed else spans)
    return joined.withColumn("found", F.array_sort(F.concat(*found)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "<secret>") -> DataFrame:
    """The rows of ``docs``, all columns, with the secrets in ``text`` replaced by ``by``.

    Overlapping spans become one. Null texts stay null. ``n_chars``, where it is a
    column, is counted anew for texts that changed.
    """
    names = docs.columns
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    kept = F.struct(F.lit(0).alias("c"), *[F.col(q).alias(f"c{i}") for i, q in enumerate(quoted) if i != at])  # under names of our own
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("was_null"), kept.alias("kept"))
    found = _joined(rows, rules)
    # the text is cut at the ends of merged spans; pieces are joined once, so a text of many secrets stays linear
    merged = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substr("text", acc["at"] + 1, s["start"] - acc["at"])))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr("text", acc["at"] + 1, F.length("text")))), by),
    )
    changed = F.size("found") > 0
    new = found.withColumn("text", F.when(F.col("was_null"), F.lit(None)).when(changed, merged).otherwise(F.col("text"))).withColumn("hit", changed)
    out = [F.col("text") if i == at else F.col("kept")[f"c{i}"] for i in range(len(names))]
    if size >= 0:
        out[size] = F.when(F.col("hit"), F.length("text").cast(docs.schema[size].dataType)).otherwise(out[size])
    return new.select(*[c.alias(n) for c, n in zip(out, names, strict=True)])


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    n = sum(rule.base for rule in RULES)
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["rank"] < n)
    counts = [F.size(F.filter("found", _of_rank(i))).cast("long").alias(f"n_{RULES[i].kind}") for i in range(n)]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
