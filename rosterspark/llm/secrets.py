"""Secret scans: a trigram index narrows each rule to candidate documents, then its regex is run on those."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import free_name, text_or_empty

#: A rule whose regex needs more alternatives than this is treated as one without mandatory trigrams.
MOST_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java and Python syntax, never matching nothing. A match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base rules; the others add kinds of their own.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
)
RULES = (*BASE, Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"), Rule("url_login", r"[a-z][a-z0-9+.]{1,15}://[^\s:@/\"']{1,64}:[^\s:@/\"']{3,64}@", 0, 12))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """A Boolean query that every text with a match fulfils: one of the branches, with all of its trigrams.

    Trigrams are lower-cased. The regex is read from its parse tree: literals are strung together, alternatives and
    small classes multiply, and anything that may vary ends the string. None: no mandatory trigrams, scan fully.
    """
    from re import _constants as op
    from re import _parser

    def parts(tree) -> list[list[str]]:
        """Branches; each is a list of strings that must occur, in which ``\\0`` ends what is known."""
        found = [""]
        for kind, value in tree:
            if kind is op.LITERAL:
                more = [chr(value).lower()]
            elif kind is op.SUBPATTERN:
                more = parts(value[3])
            elif kind is op.BRANCH:
                more = [x for branch in value[1] for x in parts(branch)]
            elif kind is op.IN and len(value) <= 4 and all(k is op.LITERAL for k, _ in value):
                more = sorted({chr(v).lower() for _, v in value})
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inside = value
                more = parts(inside)
                if (low, high) == (0, 1):
                    more = ["", *more]
                elif low == high and low <= 8:
                    more = ["".join(x) for x in product(more, repeat=low)] if len(more) ** low <= MOST_BRANCHES else ["\0"]
                else:
                    more = [f"{a}\0{b}" for a in more for b in more] if low else ["\0"]
            elif kind is op.AT:
                more = [""]
            else:
                more = ["\0"]
            found = [a + b for a in found for b in dict.fromkeys(more)]
            if len(found) > MOST_BRANCHES:
                found = ["\0"]
        return found

    branches = {frozenset(s[i : i + 3] for s in text.split("\0") for i in range(len(s) - 2)) for text in parts(_parser.parse(pattern))}
    if not all(branches):
        return None
    return sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


def postings(docs: DataFrame, trigrams: Sequence[str], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The inverted index for the given trigrams (lower case): distinct rows trigram, key (the document's id)."""
    low = F.lower(F.col(text_column))
    present = F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams)))
    some = docs.select(F.col(id_column).alias("key"), low.alias("__low")).select("key", present.alias("__present"))
    return some.select(F.explode("__present").alias("trigram"), "key")


def candidates(docs: DataFrame, rules: Sequence[Rule], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows key, kinds (array): documents whose postings fulfil the trigram query of those rules.

    The plan of the query (rule, branch, trigram) is a table of constants, some dozen rows. Postings meet it on the
    trigram; a branch holds for a document when all of its trigrams are there. A rule without a query is left out here.
    """
    spark = docs.sparkSession
    plan = [(rule.kind, f"{rule.kind}/{i}", t, len(branch)) for rule in rules for i, branch in enumerate(trigram_query(rule.pattern) or []) for t in sorted(branch)]
    if not plan:
        return docs.select(F.col(id_column).alias("key"), F.array().cast("array<string>").alias("kinds")).limit(0)
    table = spark.createDataFrame(plan, "kind string, branch string, trigram string, needed int")
    index = postings(docs, sorted({p[2] for p in plan}), id_column=id_column, text_column=text_column)
    met = index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "branch", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where(F.col("n") == F.col("needed")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it. Two levels of blocks, so the work grows far slower than the square."""
    block = 512
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(a: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        return F.aggregate(a, start, step, lambda s: s["all"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda i: F.slice(lengths, i * block + 1, F.lit(block)))
    bases = sums(F.transform(blocks, total), F.lit(0).cast("long"))
    return F.flatten(F.zip_with(blocks, bases, sums))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the rule's matches, in code points; leftmost, not overlapping.

    The pieces between matches and the matches alternate, so a match starts after the lengths of all before it.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p).cast("long"))
    lengths = F.transform(found, lambda m: F.char_length(m).cast("long"))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(lengths)), lengths, lambda p, n: p + n)
    rows = F.zip_with(F.arrays_zip(_running(steps).alias("b"), pieces.alias("p"), lengths.alias("n")), counted, lambda r, c: F.struct(
        (r["b"] + r["p"]).alias("start"), F.lit(order).alias("rank"), (r["b"] + r["p"] + r["n"]).alias("end"), F.lit(rule.kind).alias("kind"), F.char_length(c).alias("size")))
    kept = F.filter(F.slice(rows, F.lit(1), F.size(lengths)), lambda r: r["size"] >= rule.least)
    kept = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["end"].alias("end"), r["kind"].alias("kind")))
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``secrets``: array of (start, rank, end, kind), by start, then in the order of the rules.

    Native expressions only. The trigram index gives each rule its candidate documents; the rule's regex runs on those.
    Rules without mandatory trigrams run on all. Candidates are joined by the document's id, which shuffles the text
    once; with repeated ids the rows of one id are candidates together, null ids likewise, and the regex decides.

    Starts and ends count code points, the end is exclusive. Null or empty text: an empty array. Other columns pass
    through; one named secrets is replaced. Empty table: no rows.
    """
    key, kinds = free_name(docs, "__key"), free_name(docs, "__kinds")
    asked = candidates(docs, rules, id_column=id_column, text_column=text_column).toDF(key, kinds)
    rows = docs.drop("secrets").join(asked, F.col(id_column).eqNullSafe(F.col(key)), "left").drop(key)
    text = text_or_empty(text_column)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    spans = []
    for order, rule in enumerate(rules):
        here = _spans(text, rule, order)
        spans.append(here if trigram_query(rule.pattern) is None else F.when(F.array_contains(kinds, rule.kind), here).otherwise(none))
    return rows.withColumn("secrets", F.sort_array(F.flatten(F.array(*spans)))).drop(kinds)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_column: str = "text", spans_column: str = "secrets", mask: str = "[{kind}]") -> DataFrame:
    """The text with every span of ``find_secrets`` replaced by its mask; of spans that overlap, the first one counts."""
    spans, text = F.col(spans_column), F.col(text_column)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        label = F.lit(mask) if "{kind}" not in mask else F.concat(F.lit(mask.split("{kind}")[0]), x["kind"], F.lit(mask.split("{kind}")[1]))
        cut = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(cut, label)).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), 2**31 - 1))
    return docs.withColumn(text_column, F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text))
