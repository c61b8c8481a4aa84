"""Operator 2: secrets, and parts of credentials that belong together.

Three kinds stand for themselves (assignments, access identifiers, long hex). Two weaker kinds
say little alone: a bare 40-character key, an endpoint. Access identifiers, bare keys and
endpoints meet in an interval join over places of one text: both sides are dealt to bins as
wide as a scope and one more, so a bin holds a bounded number of spans and no text's spans pair freely.
A bare key is reported where an access identifier lies within the scope; an endpoint where
both an access identifier and a bare or assigned secret do.

DataFrame functions only. A pattern's places follow from the texts between its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs of so many hex digits are the runs that the contract keeps.
LONG_HEX = r"[0-9a-f]{24,}"
#: The same identifiers as spans of 20 characters and more.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""(?:https?://[^\s"'<>]+|[a-z0-9.-]+\.(?:amazonaws|example)\.com)"""
KINDS = ["assign", "access", "hex", "key", "endpoint"]
#: Code points between parts of one credential.
SCOPE = 400


#: Matches whose places are summed up together; a list that grows is copied at each step.
BLOCK = 256


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _sums(values: Column) -> Column:
    """For each value the sum of those before it."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end>> of all matches, in code points; keep: a flag for each."""
    p = F.lit(pattern)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m).cast("long"))
    between = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    flags = keep if keep is not None else F.transform(whole, lambda _: F.lit(True))
    steps = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda g, n: F.struct(g.alias("gap"), n.alias("len"))), flags, lambda s, k: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), k.alias("keep")))
    moved = lambda s: s["gap"] + s["len"]

    def places(block: Column, offset: Column) -> Column:
        starts = F.zip_with(block, _sums(F.transform(block, moved)), lambda s, at: F.struct((offset + at + s["gap"]).alias("start"), F.lit(kind).alias("kind"), (offset + at + moved(s)).alias("end"), s["keep"].alias("keep")))
        return F.transform(F.filter(starts, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def all_places(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, s: acc + moved(s)))
        return F.flatten(F.zip_with(blocks, _sums(totals), places))

    last = lambda s: F.greatest(F.floor((F.size(s) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = _once(steps, lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda k: F.slice(s, k * BLOCK + 1, BLOCK)))
    return _once(blocks, all_places)


EMPTY = "array<struct<start:bigint,kind:int,end:bigint>>"


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(EMPTY))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row per document: doc_id, base and linked (arrays of struct<start, kind, end>, sorted), and columns to keep.

    kind counts in KINDS. A null text is empty and has no spans, as has one without a match.
    Spans of one kind don't overlap; those of different kinds may. Ties at one start go by
    kind. Rows that repeat a doc_id are scanned each. Other columns of docs are ignored.

    Only texts with an access identifier and a weaker part take part in the join; they are
    written once with their row numbers, all others pass through one projection.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *kept)
    text = F.col("text")
    assigned = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    access = F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= 20)
    akia = F.contains(text, F.lit("AKIA"))
    mixed = akia & text.rlike(ACCESS_LONG) & (text.rlike(KEY) | text.rlike(ENDPOINT))
    names = [f"kept_{k}" for k in range(len(keep))]
    base = [
        _when((F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(ASSIGN), _spans(text, ASSIGN, 0, assigned)).alias("assign"),
        _when(akia, _spans(text, ACCESS, 1, access)).alias("access"),
        _when(text.rlike(LONG_HEX), _spans(text, LONG_HEX, 2)).alias("hex"),
    ]
    together = F.array_sort(F.concat("assign", "access", "hex")).alias("base")
    plain = docs.filter(~mixed).select("doc_id", *names, *base).select("doc_id", *names, together, F.array().cast(EMPTY).alias("linked"))

    weak = [_spans(text, KEY, 3).alias("key"), _spans(text, ENDPOINT, 4).alias("endpoint")]
    found = docs.filter(mixed).select("doc_id", *names, *base, *weak).select("*", together)
    found = C.checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    spans = lambda *cols: found.select("row", F.inline(F.concat(*cols)))
    # spans a scope apart end and start scope + 1 places from each other
    width = scope + 1
    bin_of = F.floor(F.col("start") / width)
    last = F.floor((F.col("end") - 1) / width)
    near = (F.greatest(F.col("w.start"), F.col("p.start")) - F.least(F.col("w.end"), F.col("p.end"))) <= scope

    def linked(weak: DataFrame, part: DataFrame) -> DataFrame:
        """Weak spans with a part of the other kind within the scope.

        A part goes to the bins that it touches, a weak span to those and the ones beside them;
        a hit in several bins counts once.
        """
        w = weak.withColumn("bin", F.explode(F.sequence(bin_of - 1, last + 1))).alias("w")
        p = part.withColumn("bin", F.explode(F.sequence(bin_of, last))).alias("p")
        hit = w.join(p, (F.col("w.row") == F.col("p.row")) & (F.col("w.bin") == F.col("p.bin")) & near, "left_semi")
        return hit.select("row", "start", "kind", "end").distinct()

    ids = spans("access")
    keys = linked(spans("key"), ids)
    ends = linked(linked(spans("endpoint"), ids), keys.unionByName(spans("assign")))
    links = keys.unionByName(ends).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    joined = found.join(links, "row", "left").select("doc_id", *names, "base", F.coalesce("linked", F.array().cast(EMPTY)).alias("linked"))
    out = plain.unionByName(joined)
    return out.select("doc_id", "base", "linked", *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]) if keep else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(C.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


MASK = "[REDACTED]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span, linked ones included, replaced by one mask; other texts stay as they are.

    Spans that overlap share a mask. A null text stays null.
    """
    columns = docs.columns
    found = scan_secrets(docs.select(F.struct(*[F.col(c) for c in columns]).alias("whole"), "doc_id", "text"), keep=("whole", "text"))
    text, spans = F.col("text"), F.array_sort(F.concat("base", "linked"))
    cut = lambda start, end: F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    # a span that starts before the last one's end only moves the end on
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when((s["start"] >= acc["at"]), F.concat(acc["out"], cut(acc["at"], s["start"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text).cast("long"))))
    out = found.select("whole.*", F.when(F.size(spans) > 0, clean).otherwise(text).alias("clean_text"))
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets and linked parts of credentials masked."""
    return redact(docs)
