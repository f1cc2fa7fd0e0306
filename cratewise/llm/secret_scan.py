"""Secrets in texts: three patterns, and runs of characters that look drawn at random.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples of the corpus itself:
what the patterns find is random, long runs in documents where they find
nothing are ordinary. What the patterns leave of a run is searched for stretches
of 16 characters or more whose steps have a mean log-likelihood ratio above a
threshold: a running sum that starts afresh where a window alone does better, so
that a key at the end of a path, or beside a pattern's find, isn't averaged away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cratewise.session import cut_lineage

# The patterns, in the order that breaks ties of equal starts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16  # characters of a run, and of a stretch in it

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # state 0 is any other character
NO_SPANS = "array<struct<start:int,k:int,end:int>>"


def _spans(body: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points; ``least`` bounds group ``value``.

    The pieces between matches and the matches give the places. The texts are
    split only where the pattern occurs at all.
    """
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(body, F.lit(pattern), F.lit(value)) if value else found
    steps = F.transform(F.arrays_zip(F.split(body, pattern, -1).alias("p"), found.alias("m"), kept.alias("g")),
                        lambda x: F.struct(F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("n"),
                                           F.char_length(x["g"]).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("k"), end.alias("end")))
        good = x["n"].isNotNull() & (x["g"] >= least)
        return F.struct(F.coalesce(end, state["at"]).alias("at"),
                        F.when(good, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return (F.when(F.rlike(body, F.lit(pattern)), F.aggregate(steps, start, step, lambda s: s["spans"]))
            .otherwise(F.array().cast(NO_SPANS)))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_body`` (the text, empty for null) and the spans of the three patterns."""
    body = F.col("_body")
    return (docs.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
            .withColumn("_assign", _spans(body, ASSIGN, 0, value=2, least=12))
            .withColumn("_access", _spans(body, ACCESS, 1))
            .withColumn("_hex", _spans(body, HEX, 2)))


def _states(run: Column) -> Column:
    return F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def fit_markov(docs: DataFrame, *, text: str = "text", sample: int = 5_000, smoothing: float = 0.5, pull: float = 5.0) -> DataFrame:
    """One row ``weights``: the log ratio of each step, random against ordinary.

    The labelled sample holds at most ``sample`` documents with a finding and
    ``sample`` without one, in the order of a hash of their texts: the
    documented bound of the training rows. Without both classes all weights
    are 0, and nothing is added to the patterns' findings.
    """
    body = F.col("_body")
    hit = F.rlike(body, F.lit(ASSIGN)) | F.rlike(body, F.lit(ACCESS)) | F.rlike(body, F.lit(HEX))
    values = F.concat(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all(body, F.lit(HEX), F.lit(0)))
    runs = F.when(F.col("_hit"), F.filter(F.array_distinct(values), lambda v: F.char_length(v) >= 12)).otherwise(
        F.array_distinct(F.regexp_extract_all(body, F.lit(RUN), F.lit(0))))
    marked = (docs.select(F.coalesce(F.col(text), F.lit("")).alias("_body"))
              .withColumn("_hit", hit).where(F.col("_hit") | F.rlike(body, F.lit(RUN)))
              .select("_hit", F.xxhash64("_body").alias("_order"), runs.alias("_runs")))
    chosen = (marked.where("_hit").orderBy("_order", "_runs").limit(sample)
              .unionByName(marked.where("not _hit").orderBy("_order", "_runs").limit(sample)))
    states = chosen.select("_hit", F.explode("_runs").alias("_run")).distinct().select("_hit", _states(F.col("_run")).alias("s"))
    steps = states.select("_hit", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.get("s", i) * STATES + F.get("s", i + 1))).alias("_step"))
    counts = steps.groupBy("_step").agg(F.count_if("_hit").alias("a"), F.count_if(~F.col("_hit")).alias("b"))
    table = (docs.sparkSession.range(0, STATES * STATES, 1, 1).select(F.col("id").cast("int").alias("_step"))
             .join(counts, "_step", "left").na.fill(0, ["a", "b"]))
    before, after, whole = Window.partitionBy(F.floor(F.col("_step") / STATES)), Window.partitionBy(F.col("_step") % STATES), Window.partitionBy(F.lit(0))

    def likelihood(n: str) -> Column:
        """Of a step, given the state before it, drawn towards the share of the state after it; STATES^2 rows in all."""
        share = (F.sum(n).over(after) + smoothing) / (F.sum(n).over(whole) + smoothing * STATES)
        return (F.col(n) + pull * share) / (F.sum(n).over(before) + pull)

    both = (F.sum("a").over(whole) > 0) & (F.sum("b").over(whole) > 0)
    ratios = table.select("_step", F.when(both, F.log(likelihood("a") / likelihood("b"))).otherwise(F.lit(0.0)).alias("w"))
    rows = ratios.agg(F.array_sort(F.collect_list(F.struct("_step", "w"))).alias("c"))
    return cut_lineage(rows.select(F.transform("c", lambda x: x["w"]).alias("weights")))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces() -> Column:
    """(start, end) of what the base spans leave of each run, if 16 characters or more, in order.

    One pass over runs and spans in the order of their starts: ``far`` is the end
    of the base spans so far, ``run`` the run last met.
    """
    piece = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("far"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("run"),
                     F.array().cast(piece).alias("out"))

    def left(state: Column, stop: Column) -> Column:
        begin = F.greatest(state["run"]["start"], state["far"])
        end = F.least(state["run"]["end"], stop)
        held = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.when(end - begin >= LEAST, F.concat(state["out"], held)).otherwise(state["out"])

    def step(state: Column, x: Column) -> Column:
        base = x["k"] < 3
        return F.struct(F.when(base, F.greatest(state["far"], x["end"])).otherwise(state["far"]).alias("far"),
                        F.when(base, state["run"]).otherwise(F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("run"),
                        left(state, x["start"]).alias("out"))

    return F.aggregate(F.sort_array(F.concat("_base", "_runs")), start, step, lambda s: left(s, s["run"]["end"]))


def _scored(pieces: Column, threshold: float) -> Column:
    """Each piece with its start and, per step, the log ratio less ``threshold``."""
    with_states = F.transform(pieces, lambda p: F.struct(
        p["start"].alias("start"), _states(F.substring(F.col("_body"), p["start"] + 1, p["end"] - p["start"])).alias("s")))
    return F.transform(with_states, lambda p: F.struct(p["start"].alias("start"), F.transform(
        F.sequence(F.lit(1), F.size(p["s"]) - 1),
        lambda i: F.get("_table", F.get(p["s"], i - 1) * STATES + F.get(p["s"], i)) - F.lit(threshold)).alias("x")))


def _stretches(piece: Column, gain: float) -> Column:
    """Spans of the stretches of a piece, 16 characters or more, whose steps sum to more than ``gain``.

    ``sum`` is the best sum of a stretch that ends here: the one before and this
    step, or the last 15 steps alone. ``top`` is the best sum met, from ``start``
    to ``end``; it is given out when a stretch that begins behind it does better
    alone, so the best stretch of all is among those given, and none overlap.
    """
    window = LEAST - 1
    x = piece["x"]
    zero, none = F.lit(0.0), F.lit(0)
    begin = F.struct(F.lit(float("-inf")).alias("sum"), none.alias("since"), zero.alias("top"), none.alias("start"), none.alias("end"),
                     zero.alias("last"), F.array().cast(NO_SPANS).alias("out"))

    def given(state: Column) -> Column:
        span = F.struct((piece["start"] + state["start"]).alias("start"), F.lit(3).alias("k"), (piece["start"] + state["end"]).alias("end"))
        return F.when(state["top"] > gain, F.concat(state["out"], F.array(span))).otherwise(state["out"])

    def step(a: Column, i: Column) -> Column:
        here = F.get(x, i - 1)
        sums = F.struct((a["sum"] + here).alias("longer"), (a["last"] + here - F.coalesce(F.get(x, i - 1 - window), zero)).alias("last"))

        def move(v: Column) -> Column:
            fresh = (i >= window) & (v["last"] > v["longer"])
            over = fresh & (a["end"] <= i - window)
            total = F.when(fresh, v["last"]).otherwise(v["longer"])
            since = F.when(fresh, i - window).otherwise(a["since"])
            better = total > F.when(over, zero).otherwise(a["top"])
            return F.struct(total.alias("sum"), since.alias("since"), F.when(better, total).when(over, zero).otherwise(a["top"]).alias("top"),
                            F.when(better, since).otherwise(a["start"]).alias("start"), F.when(better, i + 1).otherwise(a["end"]).alias("end"),
                            v["last"].alias("last"), F.when(over, given(a)).otherwise(a["out"]).alias("out"))

        return _let(sums, move)

    return F.aggregate(F.sequence(F.lit(1), F.size(x)), begin, step, given)


def scan_secrets(docs: DataFrame, weights: DataFrame, *, text: str = "text", threshold: float = 0.5, gain: float = 0.0) -> DataFrame:
    """Add counts and spans of secrets to each row; ``spans`` has (start, kind, end) of all of them.

    A stretch counts if the mean ratio of its steps exceeds ``threshold`` and the
    sum of what they have above it exceeds ``gain``; no stretch overlaps another
    or a base span.
    Null texts count as empty and have no spans. Rows are judged one by one, so
    repeated rows get equal spans. A text's spans are ordered by start, then by
    kind in the order of ``KINDS``.
    """
    df = base_spans(docs, text).withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_runs", _spans(F.col("_body"), RUN, 3)).withColumn("_table", weights.scalar())
    found = F.flatten(F.transform(_scored(_pieces(), threshold), lambda p: _stretches(p, gain)))
    df = df.withColumn("_markov", F.when(F.size("_runs") > 0, found).otherwise(F.array().cast(NO_SPANS)))
    df = df.withColumn("spans", F.sort_array(F.concat("_base", "_markov")))
    return (df.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}).withColumnRenamed("_base", "base_spans")
            .drop("_body", "_assign", "_access", "_hex", "_runs", "_table", "_markov"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")
