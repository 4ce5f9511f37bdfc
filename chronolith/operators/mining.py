"""Routine mining: sessions of steps, frequent n-grams, maximal ones, coverage, holdout, overhead."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_specific, tokens
from .temporal import HOUR, block_split

JOIN = " -> "
#: Places of a path, at most; with its number, one long.
PLACES = 1 << 24


def step_sessions(steps: DataFrame, gap_us: int, min_steps: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """session, path (its steps in order) of streams cut at gaps longer than gap_us. Steps that are null or empty end
    no session and are left out; a step equal to the one before it is too; shorter sessions go. With keep, rows: those columns
    of each step of path."""
    rows = block_split(steps.withColumn("device", F.col("stream")), gap_us).where("step <> ''")
    w = Window.partitionBy("device", "block").orderBy("ts_us", "id")
    rows = rows.where("step is not null").withColumn("same", F.lag("step").over(w).eqNullSafe(F.col("step"))).where("not same")
    out = rows.groupBy(F.concat_ws("/", "device", F.col("block").cast("string")).alias("session")).agg(F.min("ts_us").alias("start_us"), F.sort_array(F.collect_list(F.struct("ts_us", "id", "step", *keep))).alias("own"))
    out = out.select("session", "start_us", F.transform("own", lambda x: x["step"]).alias("path"), *([F.transform("own", lambda x: F.struct(*[x[c].alias(c) for c in keep])).alias("rows")] if keep else []))
    return out.where(F.size("path") >= min_steps)


#: Distinct steps up to which a step is a number of one or two bytes.
CODES = 1 << 16


def _steps(sessions: DataFrame) -> list[str] | None:
    """The distinct steps of sessions in order, None if there are more than CODES."""
    names = [r["step"] for r in sessions.select(F.explode("path").alias("step")).distinct().limit(CODES + 1).collect()]
    return sorted(names) if len(names) <= CODES else None


def _coding(names: list[str] | None):
    """(code, text, size, cut): columns that write a list of steps as bytes of a fixed width, null where a step is not
    among names, read it back, and give the number of steps and n of them from pos. Without names, lists stay as they are."""
    if names is None:
        return (lambda c: c), (lambda c: c), F.size, F.slice
    width = 1 if len(names) <= 256 else 2

    @F.arrow_udf("binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(names, pa.string())
        for lists in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            found = pc.index_in(lists.flatten(), value_set=known)
            lost = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])[ends]
            data = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(f">u{width}").tobytes()
            plain = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)])
            yield pc.if_else(pa.array(np.diff(lost) == 0), plain, pa.scalar(None, pa.binary()))

    @F.arrow_udf("array<string>")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(names, pa.string())
        for coded in batches:
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(coded).to_numpy(zero_copy_only=False), dtype=np.int64)]) // width
            steps = known.take(pa.array(np.frombuffer(b"".join(coded.to_pylist()), f">u{width}").astype(np.int32)))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), steps)

    return code, text, (lambda c: (F.length(c) / width).cast("int")), (lambda c, pos, n: F.substring(c, (pos - 1) * width + 1, n * width))


def _paths(sessions: DataFrame, coding, by: tuple[str, ...] = ()) -> DataFrame:
    """by, path (coded), times (sessions with that path), place: the number of the first of them by start_us and session
    among all first ones, start_us, session. Numbers are given within hours, which a table of one row each carries over."""
    code, hour = coding[0], F.floor(F.col("start_us") / HOUR).cast("long")
    one = sessions.select(*by, code(F.col("path")).alias("path"), "start_us", "session").groupBy(*by, "path").agg(F.count("*").alias("times"), F.min(F.struct("start_us", "session")).alias("of"))
    one = one.select(*by, "path", "times", "of.*").withColumn("hour", hour).withColumn("place", F.row_number().over(Window.partitionBy("hour").orderBy("start_us", "session", *by, "path")).cast("long"))
    hours = one.groupBy("hour").agg(F.count("*").alias("n")).select("hour", (F.sum("n").over(Window.orderBy("hour")) - F.col("n")).alias("before"))
    return one.join(hours, "hour").withColumn("place", F.col("place") + F.col("before")).drop("hour", "before")


def frequent_ngrams(sessions: DataFrame, least: int = 3, shortest: int = 3, longest: int = 60, levels: int = 4, by: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """gram, n, cnt, first of n-grams that occur least times. With by (columns of sessions, not null), for each of their
    values apart, after these columns.

    Equal paths are mined once, with the number of sessions that have them, and steps are numbers. Lengths are counted
    levels at a time at first; then one at a time while there are more and more n-grams, twice as many as before when
    there are not. An n-gram can be frequent only if both its (n-1)-grams are; where that leaves out places enough to be
    worth it, the later passes go over those that are left. The passes end when there are none."""
    names = _steps(sessions) if names is None else names
    coding = _, text, size, cut = _coding(names)
    paths = _paths(sessions, coding, by).withColumn("size", size(F.col("path"))).persist()
    sizes = [(r["size"], r["n"]) for r in paths.groupBy("size").agg(F.sum("times").alias("n")).collect()]
    every = lambda n: sum(k * max(0, length - n + 1) for length, k in sizes)
    found, alive, lo = [], paths.withColumn("at", F.lit(None).cast("array<int>")), shortest
    kinds: dict[int, int] = {}
    while lo <= longest:
        hi = min(lo + levels - 1, longest)
        n = F.explode(F.when(F.col("size") >= lo, F.sequence(F.lit(lo), F.least("size", F.lit(hi))))).alias("n")
        ends = F.col("size") - F.col("n") + 1
        pos = F.explode(F.when(F.col("at").isNull(), F.sequence(F.lit(1), ends)).otherwise(F.filter("at", lambda p: p <= ends))).alias("pos")
        occ = alive.select(*by, "path", "size", "times", "place", "at", n).select(*by, "path", "times", "place", "n", pos)
        occ = occ.select(*by, "times", "place", "pos", cut(F.col("path"), F.col("pos"), F.col("n")).alias("gram"))
        counts = occ.groupBy(*by, "gram").agg(F.sum("times").alias("cnt"), F.min(F.col("place") * PLACES + F.col("pos")).alias("first")).where(F.col("cnt") >= least).withColumn("n", size(F.col("gram"))).persist()
        found.append(counts)
        seen = {r["n"]: r for r in counts.groupBy("n").agg(F.count("*").alias("kinds"), F.sum("cnt").alias("cnt")).collect()}
        if hi not in seen:
            break
        kinds |= {k: r["kinds"] for k, r in seen.items()}
        if seen[hi]["cnt"] < 0.7 * every(hi):
            at = occ.where(size(F.col("gram")) == hi).join(counts.select(*by, "gram"), [*by, "gram"], "left_semi").groupBy(*by, "place").agg(F.collect_list("pos").alias("at"))
            both = F.array_intersect("at", F.transform("at", lambda p: p - 1))
            alive = paths.join(at.withColumn("at", both), [*by, "place"]).persist()
        lo, levels = hi + 1, 1 if kinds[hi] > 1.5 * kinds.get(hi - 1, kinds[hi]) else 2 * levels
    out = reduce(DataFrame.unionByName, found).withColumn("place", F.expr(f"first div {PLACES}"))
    out = out.join(paths.select("place", "start_us", "session"), "place").withColumn("first", F.struct("start_us", "session", (F.col("first") % PLACES).cast("int").alias("pos")))
    return out.select(*by, text(F.col("gram")).alias("gram"), "n", "cnt", "first")


def specific(grams: DataFrame, least: int = 2) -> DataFrame:
    return grams.where(F.size(F.filter("gram", is_specific)) >= least)


def maximal(grams: DataFrame) -> DataFrame:
    """grams without those whose text is contained in the text of a longer one with the same count (or of one as long
    that was seen before). No step's own name may hold the arrow that joins steps.

    An n-gram that is a run of a longer one with the same count is also a run of some n-gram with one step more and
    that count, so it is looked up among the two runs of each n-gram that lack one end. A text may else lie across
    steps: its first step is the end of another step, or its last the beginning of one. Few steps are such ends; their
    n-grams are held against those that share the count and the steps after the first."""
    g = grams.withColumn("sig", F.array_join("gram", JOIN))
    less = F.col("n").cast("int") - 1
    runs = g.where("n > 1").select("cnt", F.explode(F.array(F.slice("gram", F.lit(1), less), F.slice("gram", F.lit(2), less))).alias("gram")).distinct()
    alive = g.join(runs, ["cnt", "gram"], "left_anti")
    names = g.select(F.explode(F.array_distinct("gram")).alias("step")).distinct()
    cuts = names.where(F.length("step") > 1).select("step", F.explode(F.sequence(F.lit(1), F.length("step") - 1)).alias("k"))
    tails = cuts.select(F.expr("substring(step, k + 1)").alias("step")).distinct().join(names, "step", "left_semi")
    heads = cuts.select(F.expr("substring(step, 1, k)").alias("step")).distinct().join(names, "step", "left_semi")
    if tails.union(heads).isEmpty():  # a look at the distinct steps alone
        return alive.select("gram", "n", "cnt", "first", "sig")
    loose = alive.withColumn("step", F.get("gram", F.lit(0))).join(tails, "step", "left_semi").unionByName(alive.withColumn("step", F.element_at("gram", -1)).join(heads, "step", "left_semi")).drop("step")
    middle = F.slice("gram", F.lit(2), F.least(F.greatest(F.col("n").cast("int") - 2, F.lit(0)), F.lit(2)))
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.slice("gram", i, k))))
    other = g.select("cnt", F.col("sig").alias("s2"), F.col("n").alias("n2"), F.col("first").alias("f2"), F.explode(F.array_distinct(parts)).alias("middle"))
    inside = F.col("s2").contains(F.col("sig")) & ((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("f2") < F.col("first"))))
    lost = loose.withColumn("middle", middle).join(other, ["cnt", "middle"]).where(inside).select("cnt", "gram").distinct()
    return alive.join(lost, ["cnt", "gram"], "left_anti").select("gram", "n", "cnt", "first", "sig")


def _covered(sessions: DataFrame, grams: DataFrame, by: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """by, covered: steps inside an occurrence of one of grams; without by one row, with it none where nothing is covered."""
    names = _steps(sessions) if names is None else names
    coding = code, _, size, cut = _coding(names)
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # 58 at most
    paths = _paths(sessions, coding, by).withColumn("size", size(F.col("path")))
    n = F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.col("size"))).alias("n")
    occ = paths.select(*by, "path", "size", "times", "place", n).select(*by, "path", "times", "place", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("pos"))
    occ = occ.select(*by, "times", "place", "pos", (F.col("pos") + F.col("n")).alias("end"), cut(F.col("path"), F.col("pos"), F.col("n")).alias("gram"))
    hits = occ.join(grams.select(*by, code(F.col("gram")).alias("gram")), [*by, "gram"], "left_semi").repartition(*by, "place")
    longest = hits.groupBy(*by, "place", "pos", "times").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*by, "place").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest("pos", before), F.lit(0)) * F.col("times")
    return longest.select(*by, new.alias("new")).groupBy(*by).agg(F.coalesce(F.sum("new"), F.lit(0)).alias("covered"))


def coverage_h(sessions: DataFrame, grams: DataFrame) -> DataFrame:
    """covered, total: steps inside an occurrence of one of grams, and all steps."""
    total = sessions.agg(F.coalesce(F.sum(F.size("path")), F.lit(0)).alias("total"))
    return _covered(sessions, grams).join(total)


def holdout(sessions: DataFrame, train_days: int, **args) -> tuple[DataFrame, DataFrame]:
    """(train, test) sessions by the day they start: the first train_days days on which there are any, and the rest."""
    day = F.to_date(F.timestamp_micros("start_us"))
    dated = sessions.withColumn("day", day)
    days = dated.select("day").distinct().withColumn("r", F.row_number().over(Window.orderBy("day")))  # a row for each day
    ranked = dated.join(F.broadcast(days) if days.count() <= 100_000 else days, "day")
    return ranked.where(F.col("r") <= train_days).drop("day", "r"), ranked.where(F.col("r") > train_days).drop("day", "r")


#: Tokens of a picture of the screen, of the context and of the reasoning of one step.
SCREEN_TOKENS = {"conservative_1280x800": 1280 * 800 // 750, "typical_1512x982": 1512 * 982 // 750, "retina_1728x1117": 1728 * 1117 // 750}
CONTEXT_TOKENS, REASON_TOKENS = 350, 180


def script_lines(gram):
    """A line for each step: type, click (what is bracketed or has no slash), else navigate."""
    step = lambda s: F.when(s.startswith("type:"), F.concat(F.lit("type "), F.substring(s, 6, 1 << 30), F.lit(" <value>"))).when(s.startswith("[") | ~s.contains("/"), F.concat(F.lit("click "), s)).otherwise(F.concat(F.lit("navigate "), s))
    return F.array_join(F.transform(gram, step), "\n")


def replay_scripts(grams: DataFrame, granularity: str = "action") -> DataFrame:
    """sig, n, cnt, script: a head line with the granularity, how often and how long, then the lines of the steps."""
    head = F.concat(F.lit(f"# routine ({granularity}), "), F.col("cnt").cast("string"), F.lit("x, "), F.col("n").cast("string"), F.lit(" steps\n"))
    return grams.select(F.array_join("gram", JOIN).alias("sig"), "n", "cnt", F.concat(head, script_lines(F.col("gram"))).alias("script"))


def overhead(scripts: DataFrame) -> DataFrame:
    """sig, n, cnt, script_tokens, ratio (typical screen), conservative, retina: tokens of looking at the screen at each
    step over those of the script, to one decimal."""
    t = tokens(F.col("script"))
    by = lambda screen: F.round(F.col("n") * (SCREEN_TOKENS[screen] + CONTEXT_TOKENS + REASON_TOKENS) / F.greatest(t, F.lit(1)), 1)
    return scripts.select("sig", "n", "cnt", t.alias("script_tokens"), by("typical_1512x982").alias("ratio"), by("conservative_1280x800").alias("conservative"), by("retina_1728x1117").alias("retina"))


def nearest_rank(values: str, percent: float):
    """The element at round(percent / 100 * (n - 1)) of the sorted values of a group, halves to even."""
    sorted_ = F.sort_array(F.collect_list(values))
    return F.element_at(sorted_, (F.bround(F.lit(percent / 100) * (F.size(sorted_) - 1), 0) + 1).cast("int"))


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """n_routines, median, p25, p75 (nearest rank), lo, hi, weighted (mean by cnt); one row for each routine is held."""
    return ratios.agg(
        F.count("*").alias("n_routines"), F.expr("percentile(ratio, 0.5)").alias("median"), nearest_rank("ratio", 25).alias("p25"), nearest_rank("ratio", 75).alias("p75"),
        F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), (F.sum(F.col("ratio") * F.col("cnt")) / F.sum("cnt")).alias("weighted"),
    )


def band(n):
    return F.when(n <= 4, "3-4").when(n <= 8, "5-8").when(n <= 15, "9-15").otherwise("16+")


def ratio_bands(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy(band(F.col("n")).alias("band")).agg(F.count("*").alias("n_routines"), F.expr("percentile(ratio, 0.5)").alias("median"))


#: Fixed values of the cost model: dollars a token in and out, the share of tokens that go out, tokens of a step, the
#: share of steps that an agent with a plan still looks at.
IN_PRICE, OUT_PRICE, OUT_SHARE, STEP_TOKENS, STILL_SEEN = 3e-6, 15e-6, 0.07, 2509, 0.15


def three_arm_cost(plans: DataFrame, guard_coverage: float) -> DataFrame:
    """arm, tokens, dollars, saved_pct over all occurrences of plans (n, cnt, plan_tokens): without memory, with the plan
    in the prompt, and local replay that falls back to the first where no guard holds."""
    lost = max(0.0, 1.0 - guard_coverage)
    a = F.col("n") * STEP_TOKENS
    arms = {"rederive": a.cast("double"), "inject": F.bround(F.col("plan_tokens") + a * STILL_SEEN, 0), "replay": F.bround((1 - lost) * F.col("plan_tokens") + lost * a, 0)}
    one = plans.agg(*[F.sum(tokens_ * F.col("cnt")).alias(k) for k, tokens_ in arms.items()])
    price = (1 - OUT_SHARE) * IN_PRICE + OUT_SHARE * OUT_PRICE
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(k).alias("tokens"), F.round(F.col(k) * price, 2).alias("dollars"), F.round(100 * (1 - F.col(k) / F.col("rederive")), 1).alias("saved_pct")) for k in arms])))


def fingerprint(grams: DataFrame) -> DataFrame:
    """sha256 of a JSON list of the routines with their ratio, tokens and occurrences, by length and text: equal for
    equal results. The list has a row for each distinct routine and is one value."""
    den = tokens(script_lines(F.col("gram")))
    ratio = F.round(F.col("n") * (SCREEN_TOKENS["typical_1512x982"] + CONTEXT_TOKENS + REASON_TOKENS) / den, 3)
    sig = F.array_join("gram", JOIN)
    row = F.concat(F.lit('{"R": '), ratio.cast("string"), F.lit(', "den": '), den.cast("string"), F.lit(', "occ": '), F.col("cnt").cast("string"), F.lit(', "sig": "'), F.replace(F.replace(sig, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}'))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", sig.alias("sig"), row.alias("row")))), lambda x: x["row"])
    return grams.agg(F.sha2(F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")), 256).alias("sha256"))


def shuffled_null(sessions: DataFrame, rounds: int = 20, seed: int = 1729, **args) -> DataFrame:
    """covered, total, round: coverage by frequent n-grams of sessions whose steps are shuffled. All rounds are mined in
    the same passes, each apart from the others."""
    sessions = sessions.persist()
    every = sessions.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round"))
    total = sessions.agg(F.coalesce(F.sum(F.size("path")), F.lit(0)).alias("total"))
    many = sessions.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    many = many.withColumn("path", F.transform(F.sort_array(F.transform("path", lambda s, k: F.struct(F.xxhash64(F.lit(seed) + F.col("round"), "session", k).alias("r"), s.alias("s")))), lambda x: x["s"]))
    names = _steps(sessions)
    counts = _covered(many, specific(frequent_ngrams(many, by=("round",), names=names, **args)), ("round",), names)
    return every.join(counts, "round", "left").join(total).select(F.coalesce("covered", F.lit(0)).alias("covered"), "total", "round")


def entropy_rate(sequences: DataFrame, longest: int = 60, most: int = 12_000) -> DataFrame:
    """name, n, bits: the Lempel-Ziv entropy rate of each sequence (columns name, path), by the longest earlier match
    at each place, of its first most symbols. Inherently sequential; one sequence is one task."""

    def rate(pdf):
        import math

        import pandas as pd

        out = []
        for name, path in zip(pdf["name"], pdf["path"]):
            code: dict = {}
            text = "".join(chr(0x100 + code.setdefault(s, len(code))) for s in list(path)[:most])
            n, total = len(text), 0
            for i in range(n):
                lo = 0
                while lo < longest and i + lo < n and text.find(text[i : i + lo + 1], 0, i) >= 0:
                    lo += 1
                total += lo + 1
            out.append((name, n, n * math.log2(n) / total if n > 1 else 0.0))
        return pd.DataFrame(out, columns=["name", "n", "bits"])

    return sequences.groupBy("name").applyInPandas(rate, "name string, n long, bits double")


def fano_bound(bits: float, symbols: int, rounds: int = 60) -> float:
    """The greatest predictability that an entropy rate over so many symbols allows, by bisection."""
    import math

    if symbols < 2 or bits <= 0:
        return 1.0
    lo, hi = 1.0 / symbols, 1.0 - 1e-12
    for _ in range(rounds):
        p = (lo + hi) / 2
        h = -p * math.log2(p) - (1 - p) * math.log2(1 - p) + (1 - p) * math.log2(max(symbols - 1, 1))
        lo, hi = (p, hi) if h > bits else (lo, p)
    return (lo + hi) / 2
