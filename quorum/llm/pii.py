"""Personal data by fixed patterns and by contexts learned from what these find.

Fixed patterns find the *base* spans. Their instances seed a bootstrap, as do long hexadecimal
tokens that are assigned as quoted values (kind ``secret``): the words before an instance are a
*pattern*; other identifier-like tokens that stand behind the same words are instances of it as
well. Patterns and instances form a graph that Spark scores in turns, for each kind by itself:

* a pattern's confidence is the mean score of its distinct instances; it is trusted once that is
  at least MIN_CONFIDENCE and at least MIN_SEEDS of them have a score;
* an instance's score is the highest confidence of its trusted patterns, 0 without one; seeds
  keep 1 for their own kind and 0 for the others.

So what one pattern finds can induce the next in the following turn, and a pattern that isn't
trusted lends nothing to its instances, and hence nothing to itself. Every token behind a pattern
that is trusted in the last turn is a span of its most confident kind (ties: the first of
SEED_KINDS), unless it overlaps a base span. A secret's shape alone is no span; its context has
to be trusted. All rows take part, in sums that combine before they are shuffled.

DataFrame functions only. Positions come from the lengths of the pieces between matches, and
are added up by a window over a row's matches, so a text with very many of them stays linear.
The same window joins the last pieces to the CONTEXT_CHARS characters that precede a match.
The repetitions of the patterns are possessive and their starts anchored where that changes no
match, so that long runs of characters neither backtrack nor overflow the stack.

* null and empty texts have no spans. Repeated rows have equal results and count as separate
  occurrences but as one instance. Extra columns are not read. An empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import release, skew_join, stored, stored_mark, stored_since

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "\\+"}
#: Identifier-like: a token of letters, digits and joining marks with a digit in it.
TOKEN = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{5,}+"
TOKEN_KIND = "token"
SECRET_KIND = "secret"
SEED_KINDS = (*KINDS, SECRET_KIND)
#: Secrets that seed: hexadecimal tokens with letters and digits, assigned as a quoted value.
SECRET = r"^(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+$"
ASSIGNED = r"[=:]\s*+[\"']$"
#: Characters before an instance that may belong to its pattern, and how many words do.
CONTEXT_CHARS = 60
#: So many matches before one fill its context, even the shortest: two characters, one between.
CONTEXT_MATCHES = CONTEXT_CHARS // 3
CONTEXT_WORDS = 2
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
TURNS = 3
MATCHES = "array<struct<kind:string,k:int,gap:bigint,found:string,before:string,tail:string>>"
NOT_DIGIT = r"[^0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]|)"


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match meets what its kind asks beyond the pattern."""
    digits = F.regexp_replace(match, NOT_DIGIT, "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & F.coalesce(F.expr("luhn_check(regexp_replace(found, '[^0-9]', ''))"), F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _end(text: Column) -> Column:
    """The last CONTEXT_CHARS characters."""
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def _matches(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Array of (kind, k, gap, found, before, tail) of one kind; ``gap`` is the distance to the match
    before, ``before`` the end of what lies in it, ``tail`` that of gap and match together."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")),
        lambda m, k: F.struct(
            F.lit(kind).alias("kind"),
            k.alias("k"),
            F.length(m["gap"]).cast("long").alias("gap"),
            m["found"].alias("found"),
            _end(m["gap"]).alias("before"),
            _end(F.concat(m["gap"], m["found"])).alias("tail"),
        ),
    )
    empty = F.array().cast(MATCHES)
    return F.when(text.rlike(needs), rows).otherwise(empty)


def _all_matches(docs: DataFrame, id_column: str) -> DataFrame:
    """One row per match, and one more for every row of ``docs`` (``kind`` is null), whatever it
    holds: ``row``, the id, ``kind``, ``start``, ``end`` (code points), ``found``, ``before``."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column), F.coalesce("text", F.lit("")).alias("t")
    )
    kinds = [_matches(F.col("t"), k, PATTERNS[k], NEEDS[k]) for k in KINDS]
    tokens = _matches(F.col("t"), TOKEN_KIND, TOKEN, "[0-9]")
    itself = F.array(F.lit(None)).cast(MATCHES)
    exploded = rows.select("row", id_column, F.explode(F.concat(itself, *kinds, tokens)).alias("m")).select("row", id_column, "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(so_far)
    # The text before a match is put together from the ends of the pieces before it: the whole
    # text would have to go with every match, and be walked from its start.
    earlier = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(-CONTEXT_MATCHES, -1)
    before = _end(F.concat(F.array_join(F.collect_list("tail").over(earlier), ""), F.col("before")))
    return exploded.select(
        "row", id_column, "kind", (end - F.length("found")).alias("start"), end.alias("end"), "found", before.alias("before")
    ).filter(F.col("kind").isNull() | (F.col("kind") == TOKEN_KIND) | _valid(F.col("kind"), F.col("found")))


def _pattern(before: Column) -> Column:
    """The last words before an instance, in lower case, digits as 0; null if there are too few."""
    tail = F.regexp_extract(F.lower(before), rf"(?:^|\s)(\S++(?:\s++\S++){{{CONTEXT_WORDS - 1}}})\s*+[\"'(:=]*+$", 1)
    words = F.regexp_replace(F.regexp_replace(tail, r"\s+", " "), "[0-9]", "0")
    return F.when(words != "", words)


def _seed_kind(kind: Column, found: Column, before: Column) -> Column:
    """The kind an occurrence is a seed of, or null."""
    secret = found.rlike(SECRET) & before.rlike(ASSIGNED)
    return F.when(kind != TOKEN_KIND, kind).when(secret, SECRET_KIND)


def trusted_patterns(spans: DataFrame) -> DataFrame:
    """``pattern``, ``as_kind``, ``confidence`` of the contexts that seeds, and what these led to,
    vouch for."""
    seen = spans.filter(F.col("kind").isNotNull()).select(
        _pattern(F.col("before")).alias("pattern"),
        F.lower("found").alias("instance"),
        _seed_kind(F.col("kind"), F.col("found"), F.col("before")).alias("seed"),
    )
    is_seed = [F.max(F.when(F.col("seed") == k, 1.0).otherwise(0.0)).alias(k) for k in SEED_KINDS]
    edges = stored(seen.filter(F.col("pattern").isNotNull()).groupBy("pattern", "instance").agg(*is_seed))
    # A context of fewer instances can never have enough seeds: the graph is that of the others.
    enough = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS)
    graph = stored(skew_join(edges, stored(enough.select("pattern")), "pattern", "inner"))
    scores = graph.groupBy("instance").agg(*[F.max(k).alias(k) for k in SEED_KINDS])
    scores = stored(scores.withColumn("is_seed", F.greatest(*SEED_KINDS) == 1.0))
    links = graph.select("pattern", "instance")
    trust = [(F.count_if(F.col(k) > 0) >= MIN_SEEDS) & (F.avg(k) >= MIN_CONFIDENCE) for k in SEED_KINDS]
    for _ in range(TURNS):
        scored = stored(skew_join(links, scores, "instance", "inner"))
        vouched = [F.when(t, F.avg(k)).otherwise(0.0).alias(f"by_{k}") for k, t in zip(SEED_KINDS, trust)]
        confidence = stored(scored.groupBy("pattern").agg(*vouched))
        best = skew_join(scored, confidence, "pattern", "inner").groupBy("instance", "is_seed")
        found = best.agg(*[F.max(k).alias(k) for k in SEED_KINDS], *[F.max(f"by_{k}").alias(f"by_{k}") for k in SEED_KINDS])
        grown = [F.when(F.col("is_seed"), F.col(k)).otherwise(F.greatest(k, f"by_{k}")).alias(k) for k in SEED_KINDS]
        scores = stored(found.select("instance", "is_seed", *grown))
    top = F.greatest(*[f"by_{k}" for k in SEED_KINDS])
    as_kind = F.coalesce(*[F.when(F.col(f"by_{k}") == F.col("confidence"), k) for k in SEED_KINDS])
    trusted = confidence.withColumn("confidence", top).filter(F.col("confidence") > 0)
    return trusted.select("pattern", as_kind.alias("as_kind"), "confidence")


def find(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``spans``, both sorted arrays of
    (``rank`` of the kind, ``start``, ``end``, ``kind``)."""
    spans = stored(_all_matches(docs, id_column))
    mark = stored_mark()
    trusted = stored(trusted_patterns(spans).select("pattern", "as_kind"))
    release(docs.sparkSession, stored_since(mark)[:-1])  # the turns' own tables
    tokens = spans.filter(F.col("kind") == TOKEN_KIND).withColumn("pattern", _pattern(F.col("before")))
    base = spans.filter(F.col("kind").isNull() | (F.col("kind") != TOKEN_KIND))
    found = skew_join(tokens.filter(F.col("pattern").isNotNull()), trusted, "pattern", "inner").select(
        "row", id_column, F.col("as_kind").alias("kind"), "start", "end", F.lit(True).alias("learned")
    )
    rows = base.select("row", id_column, "kind", "start", "end", F.lit(False).alias("learned")).unionByName(found)
    rank = F.array_position(F.array(*map(F.lit, SEED_KINDS)), F.col("kind")).cast("int")
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    per_row = rows.groupBy("row").agg(
        F.first(id_column).alias(id_column),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull() & ~F.col("learned"), span))).alias("base"),
        F.sort_array(F.collect_set(F.when(F.col("learned"), span))).alias("more"),
    )
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return per_row.select(id_column, "base", F.sort_array(F.concat("base", free)).alias("spans"))


def spell(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

