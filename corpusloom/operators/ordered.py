"""Operators that depend on the order of rows: segments, batches, parts, subsets and splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..plans.ordering import hashed, numbered, reliable, running_total, tile, with_neighbours

BLOCK = 50_000  # rows that one task batches

# ---- segments


def extended_segments(segments: DataFrame, seconds: float, block: int = 4096) -> DataFrame:
    """Each segment longer by `seconds` at both ends, at most to the middle of the gap to its neighbour in the recording; starts stay at or above zero.

    Neighbours that overlap already stay as they are towards each other. Neighbours are found in blocks of rows that borrow each other's edges,
    so that a recording of any length is many tasks.
    """
    rows = with_neighbours(segments, ["reco", "start", "end", "uttid"], 1, block)
    w = Window.partitionBy("_block", "reco").orderBy("_rn")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    left = F.when(before.isNull(), F.greatest(F.lit(0.0), F.col("start") - seconds)).when(before < F.col("start"), F.col("start") - F.least(F.lit(float(seconds)), (F.col("start") - before) / 2)).otherwise(F.col("start"))
    right = F.when(after.isNull(), F.col("end") + seconds).when(after > F.col("end"), F.col("end") + F.least(F.lit(float(seconds)), (after - F.col("end")) / 2)).otherwise(F.col("end"))
    out = rows.select("uttid", "reco", F.round(left, 2).alias("new_start"), F.round(right, 2).alias("new_end"), *[c for c in segments.columns if c not in ("uttid", "reco", "start", "end")], "_own").where("_own").drop("_own")
    return out.withColumnsRenamed({"new_start": "start", "new_end": "end"})


def segment_slices(segments: DataFrame, signals: DataFrame) -> DataFrame:
    """(uttid, x, rate): the samples of each segment; an end of -1 is the end of the recording. signals: reco, x, rate."""
    first = (F.col("start") * F.col("rate")).cast("int")
    last = F.when(F.col("end") == -1, F.size("x")).otherwise(F.least((F.col("end") * F.col("rate")).cast("int"), F.size("x")))
    return segments.join(signals, "reco").select("uttid", F.slice("x", first + 1, F.greatest(last - first, F.lit(0))).alias("x"), "rate")


# ---- batches and parts


def fixed_batches(df: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """(…, rn, batch, pos) with `size` rows a batch, in order."""
    out, _ = numbered(df, order)
    return out.withColumn("batch", F.floor((F.col("rn") - 1) / size)).withColumn("pos", ((F.col("rn") - 1) % size).cast("int"))


def _next_starts(lengths: np.ndarray, size: int, budget: float) -> np.ndarray:
    """For each row the row after the batch that starts with it: the longest run of at most size rows whose lengths stay within the budget, one row at least."""
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.float64)])
    n = len(lengths)
    by_budget = np.searchsorted(total, total[:-1] + budget, side="right") - 1
    at = np.arange(n)
    return np.clip(np.minimum(by_budget, at + size), at + 1, n)


def dynamic_batches(df: DataFrame, order: Sequence[Column | str], length: str, size: int, max_len: float, block: int = BLOCK) -> DataFrame:
    """(…, rn, batch, pos): batches of at most `size` rows whose lengths sum to max_len * size at most, one row at least.

    A batch begins where the one before it ends, through the whole order. Blocks of rows run in parallel: a batch that enters
    a block enters at one of its first `size` rows, so each block says for every such entry where it is left and how many
    batches that takes; the driver strings these short lists together, and each block then numbers its batches.
    """
    block = max(block, 2 * size)
    rows, _ = numbered(df, order)
    narrow = rows.select("rn", F.col(length).cast("double").alias("len"))
    own = ((F.col("rn") - 1) / block).cast("long")
    halo = F.when(((F.col("rn") - 1) % block < size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = reliable(narrow.select("rn", "len", own.alias("own"), F.explode(halo).alias("block")))
    budget = float(max_len) * size

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        k, n = int(pdf["block"].iloc[0]), int((pdf["own"] == pdf["block"]).sum())
        nxt = _next_starts(pdf["len"].to_numpy(), size, budget)
        exits, counts = np.zeros(n, np.int64), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = nxt[i]
            exits[i], counts[i] = (j - n, 1) if j >= n else (exits[j], counts[j] + 1)
        m = min(size, n)
        return pd.DataFrame({"block": k, "entry": np.arange(m), "leave": exits[:m], "batches": counts[:m], "n": n})

    paths = {}
    for r in dealt.groupBy("block").applyInPandas(ways, "block long, entry long, leave long, batches long, n long").collect():  # `size` rows a block
        paths[r.block, r.entry] = (r.leave, r.batches, r.n)
    entries, entry, base = [], 0, 0
    for k in range(max((b for b, _ in paths), default=-1) + 1):
        n = paths[k, 0][2]
        if entry >= n:  # the batch that enters ends beyond this short last block
            entries.append((k, n, base))
            entry -= n
            continue
        leave, batches, _ = paths[k, entry]
        entries.append((k, entry, base))
        entry, base = leave, base + batches
    starts = df.sparkSession.createDataFrame(entries or [(0, 0, 0)], "block long, entry long, base long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn").reset_index(drop=True)
        n, i, batch = int((pdf["own"] == pdf["block"]).sum()), int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])
        nxt, out = _next_starts(pdf["len"].to_numpy(), size, budget), []
        while i < n:
            j = int(nxt[i])
            out.append(pd.DataFrame({"rn": pdf["rn"].iloc[i:j], "batch": batch, "pos": np.arange(j - i)}))
            i, batch = j, batch + 1
        return pd.concat(out) if out else pd.DataFrame({"rn": [], "batch": [], "pos": []})

    given = dealt.join(F.broadcast(starts), "block")  # one row a block
    batches = given.groupBy("block").applyInPandas(number, "rn long, batch long, pos int")
    return rows.join(batches, "rn")


def parts_of_batches(batches: DataFrame, parts: int) -> DataFrame:
    """batches (with column batch, from 0 without gaps) with part: contiguous, the first ones get what is left over. Fewer batches than parts is an error."""
    total = (batches.agg(F.max("batch")).first()[0] or 0) + 1
    if total < parts:
        raise RuntimeError(f"{total} batches can't go to {parts} parts")
    return batches.withColumn("part", tile(F.col("batch") + 1, total, parts))


def equal_parts(batches: DataFrame, parts: int) -> DataFrame:
    """parts_of_batches, with one of the first batches again at the end of each part that is a batch short, so that all parts have as many."""
    out = parts_of_batches(batches, parts)
    total = (batches.agg(F.max("batch")).first()[0] or 0) + 1
    extra = total % parts
    if not extra:
        return out.withColumn("padded", F.lit(False))
    again = out.where(F.col("batch") < parts - extra).withColumn("part", (F.col("batch") + extra).cast("int"))
    return out.withColumn("padded", F.lit(False)).unionByName(again.withColumn("padded", F.lit(True)))


def epoch_order(df: DataFrame, epoch: int, archive: str = "archive", utt: str = "uttid") -> DataFrame:
    """df with pos (from 0): archives in the epoch's order, and in each its utterances in the epoch's order."""
    out, _ = numbered(df, [hashed(epoch, archive), F.col(archive), hashed(epoch, utt), F.col(utt)])
    return out.withColumn("pos", F.col("rn") - 1).drop("rn")


def legacy_epoch_order(df: DataFrame, epoch: int, archive: str = "archive", utt: str = "uttid", order: str = "ord") -> DataFrame:
    """The order that numpy's RandomState(epoch) gives: a permutation of the archives, then one of each archive's utterances, drawn in order of first appearance.

    The stream is one after the other by its nature: the driver runs through it, archive by archive, and keeps the
    generator's state before each and where the archive begins. The tasks draw the permutations again, an archive each.
    """
    ranked, _ = numbered(df, [order])
    sizes = ranked.groupBy(archive).agg(F.count("*").alias("n"), F.min("rn").alias("first")).orderBy("first").collect()  # a row for each archive
    rng = np.random.RandomState(epoch)
    turn, states = rng.permutation(len(sizes)), []
    for r in sizes:
        _, words, at, *_ = rng.get_state()
        states.append((words.tobytes(), int(at)))
        rng.permutation(r.n)
    base = np.zeros(len(sizes), np.int64)
    base[turn] = np.concatenate([[0], np.cumsum([sizes[i].n for i in turn])])[:-1] if sizes else []
    kind = df.schema[archive].dataType.simpleString()
    given = df.sparkSession.createDataFrame([(r[archive], int(base[i]), *states[i]) for i, r in enumerate(sizes)], f"{archive} {kind}, _base long, _words binary, _at int")

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.random.RandomState()
        own.set_state(("MT19937", np.frombuffer(pdf["_words"].iloc[0], np.uint32), int(pdf["_at"].iloc[0])))
        rows = np.sort(pdf["rn"].to_numpy())
        return pd.DataFrame({"rn": rows, "pos": pdf["_base"].iloc[0] + np.argsort(own.permutation(len(rows)), kind="stable")})

    places = ranked.select(archive, "rn").join(given, archive).groupBy(archive).applyInPandas(drawn, "rn long, pos long")
    return ranked.join(places, "rn").drop("rn")


# ---- archives


def archive_files(df: DataFrame, order: Sequence[Column | str], seconds: str, max_seconds: float, jobs: int | None = None) -> DataFrame:
    """df with job and file_idx (from 1): each of `jobs` writers (one for BLOCK rows unless given) takes a contiguous stretch and opens its next file when an utterance would make the open one too long.

    An utterance longer than the limit has a file of its own. A writer's stretch is one task; jobs set its size.
    """
    rows, total = numbered(df, order)
    jobs = max(1, min(jobs or -(-total // BLOCK), total))
    given = rows.withColumn("job", tile(F.col("rn"), total, jobs))

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        now, n, out = 0.0, 1, []
        for s in pdf["sec"]:
            if now + s > max(s, max_seconds):
                now, n = 0.0, n + 1
            now += s
            out.append(n)
        return pd.DataFrame({"rn": pdf["rn"], "file_idx": out})

    files = given.select("job", "rn", F.col(seconds).cast("double").alias("sec")).groupBy("job").applyInPandas(roll, "rn long, file_idx int")
    return given.join(files, "rn")


# ---- chunks and subsets


def chunks(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """df with chunk (from 0): n contiguous chunks of nearly equal size, the larger ones first. More chunks than rows is an error."""
    out, total = numbered(df, order)
    if total < n:
        raise ValueError(f"{total} rows can't make {n} chunks")
    return out.withColumn("chunk", tile(F.col("rn"), total, n))


def settled(edges: list[int], until: Callable[[int], int]) -> list[int]:
    """Edges between chunks of a row of groups, moved while that evens out the two chunks at an edge. until(i): the rows of the first i groups.

    Chunk after chunk, its upper edge is tried one group lower and its lower edge one group higher; an empty chunk has nothing to give. An edge moves if
    the chunks at both its sides then differ by less. It ends when no edge has moved for as many tries as there are.
    """
    n = len(edges) - 1
    tries = [(chunk, edge, step) for chunk in range(n) for edge, step in ((chunk + 1, -1), (chunk, 1)) if 0 < edge < n]
    quiet = turn = 0
    while quiet < len(tries):
        chunk, edge, step = tries[turn % len(tries)]
        ends = until(edges[edge - 1]) + until(edges[edge + 1])
        moves = edges[chunk] < edges[chunk + 1] and abs(ends - 2 * until(edges[edge] + step)) < abs(ends - 2 * until(edges[edge]))
        edges[edge] += step * moves
        quiet, turn = 0 if moves else quiet + 1, turn + 1
    return edges


def first_edges(groups: int, n: int) -> list[int]:
    """Edges of n chunks with about as many groups each."""
    if groups < n:
        raise ValueError(f"{groups} speakers can't make {n} chunks")
    return [-(-i * groups // n) for i in range(n + 1)]


def balanced(counts: Sequence[int], n: int) -> list[int]:
    """The chunk of each of a row of groups; see settled()."""
    edges = settled(first_edges(len(counts), n), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist().__getitem__)
    return [i for i in range(n) for _ in range(edges[i + 1] - edges[i])]


def speaker_chunks(df: DataFrame, order: Sequence[Column | str], n: int, speaker: str = "speaker", around: int = 2000) -> DataFrame:
    """df with chunk: n chunks of whole speakers, in order of first appearance; see settled().

    Speakers and their running totals are tables. The driver holds n edges and, of the totals, `around` to each side of an edge, and asks for more where an edge moves further.
    """
    rows, _ = numbered(df, order)
    counts = rows.groupBy(speaker).agg(F.count("*").alias("_n"), F.min("rn").alias("_first"))
    ranked, groups = numbered(counts, ["_first"], "_spk")
    totals = reliable(running_total(ranked.select("_spk", "_n"), "_spk", "_n", "_until"))
    edges, known = first_edges(groups, n), {0: 0}

    def fetch(places: list[int]) -> None:
        near = F.exists(F.array(*map(F.lit, places)), lambda e: F.abs(F.col("_spk") - e) <= around)
        known.update((r["_spk"], r["_until"]) for r in totals.where(near).select("_spk", "_until").collect())  # at most 2 * around + 1 a place

    def until(i: int) -> int:
        if i not in known:
            fetch([i])
        return known[i]

    fetch(edges)
    inner = settled(edges, until)[1:-1]
    chunk = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e < F.col("_spk"))) if inner else F.lit(0)
    return rows.join(ranked.select(speaker, chunk.cast("int").alias("chunk")), speaker)


def even_subset(df: DataFrame, order: Sequence[Column | str], n: int, quiet: bool = False) -> DataFrame:
    """n rows spread evenly over the order: halves of the rows give halves of the number, the right ones what is odd."""
    out, total = numbered(df, order)
    if n > total and not quiet:
        raise ValueError(f"{n} rows asked for, {total} there")
    state = F.struct(F.lit(0).cast("long").alias("s"), F.lit(total).cast("long").alias("e"), F.lit(min(n, total)).cast("long").alias("k"))

    def halve(x: Column, _: Column) -> Column:
        half, need = F.floor((x["e"] - x["s"]) / 2), F.floor(x["k"] / 2)
        left = F.col("rn") - 1 < x["s"] + half
        return F.when(x["e"] - x["s"] <= 1, x).otherwise(F.struct(F.when(left, x["s"]).otherwise(x["s"] + half).alias("s"), F.when(left, x["s"] + half).otherwise(x["e"]).alias("e"), F.when(left, need).otherwise(x["k"] - need).alias("k")))

    depth = max(1, int(total).bit_length() + 1)
    return out.where(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, halve)["k"] > 0)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n in order."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n in order."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def shortest(df: DataFrame, n: int, frames: str = "num_frames", tie: str = "uttid") -> DataFrame:
    return df.orderBy(frames, tie).limit(n)


def per_speaker(df: DataFrame, n: int, speaker: str = "speaker", order: str = "uttid") -> DataFrame:
    """About n of each speaker's m utterances: every (m // n)-th one. Places follow from the rows' numbers, so that a speaker of any size is many tasks."""
    rows, _ = numbered(df, [speaker, order], "_rn")
    spans = rows.groupBy(speaker).agg(F.min("_rn").alias("_first"), F.count("*").alias("_m")).withColumnRenamed(speaker, "_speaker")
    i, skip = F.col("_rn") - F.col("_first"), F.greatest(F.lit(1), F.floor(F.col("_m") / n))
    return rows.join(spans, F.col(speaker).eqNullSafe(F.col("_speaker"))).where((i % skip == 0) & (i < n * skip)).select(*df.columns)


def whole_speakers(df: DataFrame, n: int, seed: int | str = 0, speaker: str = "speaker") -> DataFrame:
    """All utterances of speakers in a seeded order, while those before them have fewer than n."""
    counts = df.groupBy(speaker).agg(F.count("*").alias("m"))
    ranked, _ = numbered(counts, [hashed(seed, speaker), F.col(speaker)])
    # running sums over at most n speakers: each has one utterance at least
    w = Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    chosen = ranked.where(F.col("rn") <= n).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0))).where(F.col("before") < n)
    return df.join(chosen.select(speaker), speaker, "left_semi")


def speaker_split(df: DataFrame, percent: float = 10, seed: int = 777, speaker: str = "speaker") -> DataFrame:
    """df with split: the first int(percent * n / 100) of n speakers in a seeded order are cv, the others train."""
    ranked, total = numbered(df.select(speaker).distinct(), [hashed(seed, speaker), F.col(speaker)])
    split = F.when(F.col("rn") <= int(percent * total / 100), "cv").otherwise("train")
    return df.join(ranked.select(speaker, split.alias("split")), speaker)


def prompt_split(df: DataFrame, dev: int = 10, test: int = 10, seed: int = 0, text: str = "text") -> DataFrame:
    """df with split: distinct sentences in a seeded order are dev, then test, then train; utterances follow their sentence."""
    keyed = df.withColumn("_prompt", F.md5(squeezed(F.col(text))))
    ranked, total = numbered(keyed.select("_prompt").distinct(), [hashed(seed, "_prompt")])
    d, t = total * dev // 100, total * test // 100
    split = F.when(F.col("rn") <= d, "dev").when(F.col("rn") <= d + t, "test").otherwise("train")
    return keyed.join(ranked.select(F.col("_prompt").alias("_key"), split.alias("split")), F.col("_prompt") == F.col("_key")).drop("_prompt", "_key")


def capped_duplicates(df: DataFrame, most: int, order: str = "ord", text: str = "text", step: int = 103_349, modulus: int = 71_147) -> DataFrame:
    """Rows of texts that occur fewer than `most` times, and of the others those whose draw is under most / n.

    Draws are k / modulus with k = (j * step) mod modulus for the j-th row of the others, in order.
    """
    if most <= 1:
        raise ValueError("most must be over 1")
    keyed = df.withColumn("_text", F.md5(squeezed(F.col(text))))
    n = keyed.groupBy("_text", F.xxhash64("_text")).agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select(F.col("_text").alias("_key"), "_n")
    often = keyed.join(n, F.col("_text") == F.col("_key")).select(order, "_n")
    drawn, _ = numbered(often, [order])
    k = (F.col("rn") * step) % modulus
    gone = drawn.where(~(k / modulus < most / F.col("_n"))).select(F.col(order).alias("_gone"))
    return df.join(gone, df[order] == gone["_gone"], "left_anti")


def shuffled(df: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(hashed(seed, *columns), *columns)
