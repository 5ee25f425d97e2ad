"""Problem 1: the same or nearly the same records across splits, by a distributed suffix array.

The texts' plain forms are one concatenated string, cut at record ends.  Its suffixes are shuffled to
ranges of their first characters (splitters from a sample), sorted by their first characters
inside, and scanned once: neighbours with a common prefix form an interval, and every interval with
suffixes of both split sides is a span that evaluation and training texts share.

*Pairs* (``p1_found``) come from a sparse array that is exact.  Its positions are those of the rarest
runs of three of each text: with n distinct runs, ordered by their counts over all texts, the first
n - ceil(0.6 n) + 1.  Two texts of a likeness of 0.6 then hold a common run among these positions of
both, so they stand in one interval of common prefixes of three characters or more.  Inside an
interval a pair is dropped only if it cannot reach the likeness: by its numbers of runs, by the
places of the common run in both orders, or by the parities of the runs in 192 classes (two texts
differ in no more classes than they have runs of their own).  What is left is compared exactly.
Stock phrases stand last in every text's order, so they take part only in texts that hardly hold
anything else.  An interval of more than CELL suffixes is cut into a grid of cells of that size on
a side, which lie in different parts; no interval is capped.

*Spans* (``p1_report``) come from the full array: every evaluation suffix is compared with its
neighbour among the training suffixes; common prefixes of at least SPAN characters are merged per
record, and the coverage of a record is the share of its characters in the union.  An evaluation text
inside a much longer training text is covered, though it is like no training text.

Equal plain forms of one split side are collapsed to one representative before any suffix is made, so
a group of copies of any size costs one text.  Nulls and texts without a letter or digit match
nothing; a plain form of one or two characters has no run of three and is like its equals only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.forms import mix, to_codes, trigram_codes
from corpusloom.llm.likeness import likeness_of_plain, plain_column
from corpusloom.llm.tables import first_value, stored, table

LIKENESS = 0.6
#: Shortest common prefix that counts as a shared span in the report.
SPAN = 10
#: A record of the report is contained if at least this share of it lies in shared spans.
CONTAINED = 0.8
#: Runs of three are ordered by the counts of so many buckets of them (4 MB of counts in each task).
BUCKETS = 1 << 20
#: Suffixes of an interval that one task compares with one another, on each side.
CELL = 100_000
#: Parities of the runs of a text, 64 classes in each.
MARKS = ("m1", "m2", "m3")
CLASSES = 64 * len(MARKS)
#: Pairs of an interval from which on it is compared in rectangles of so many training and evaluation texts (1 MB).
DENSE, WIDE, HIGH = 4096, 4096, 32
#: Splitters and large intervals are taken from the suffixes of every so manieth text; they decide on balance only.
EVERY = 64
#: Suffixes of a part and of a task, about, and parts and tasks at most.
PART, TASK, PARTS, TASKS = 100_000, 500_000, 10_000, 10_000


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, side (0 train, 1 evaluation), split, source, text of the tables that have splits."""
    qa = table(spark, sf_dir, "qa_records").select(F.lit("qa_records").alias("tbl"), F.col("record_id").alias("id"), "split", "source", F.col("query").alias("text"))
    chat = table(spark, sf_dir, "chat_samples").select(F.lit("chat_samples").alias("tbl"), F.col("sample_id").alias("id"), "split", "source", first_value("conversations", "human").alias("text"))
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("development", "heldout"), 1)
    return qa.unionByName(chat).withColumn("side", side).where("side is not null and text is not null")


def representatives(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (tbl, kind, rep, plain) and membership (tbl, side, id, rep, split, source).

    ``texts``: tbl, id, side (0 train, 1 evaluation), split, source, text; other columns are ignored.
    ``kind``: a hash of the table's name, doubled, plus the side.
    """
    formed = texts.select("tbl", "id", F.col("side").cast("tinyint").alias("side"), "split", "source", plain_column("text").alias("plain"))
    keyed = formed.where("plain <> ''").withColumns({"h": F.xxhash64("plain"), "g": F.xxhash64(F.lit(17), "plain")})
    same = ["tbl", "side", "h", "g"]
    reps = stored(keyed.groupBy(*same).agg(F.min("id").alias("rep"), F.first("plain").alias("plain")), "p1-texts")
    members = keyed.select(*same, "id", "split", "source").distinct().join(reps.select(*same, "rep"), same)
    kind = (F.hash("tbl").cast("long") * 2 + F.col("side")).alias("kind")
    return reps.select("tbl", kind, "rep", "plain"), members.select("tbl", "side", "id", "rep", "split", "source")


def runs_of_three(plain: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and position in the batch of every run of three of a batch of plain forms."""
    codes, starts = to_codes(plain)
    runs = trigram_codes(codes)
    row = np.repeat(np.arange(len(plain)), np.diff(starts))[: len(runs)]
    at = np.flatnonzero(np.arange(len(runs)) + 3 <= starts[1:][row])
    return row[at], runs[at], at


def bucket_of(runs: np.ndarray) -> np.ndarray:
    return (mix(runs) & np.uint64(BUCKETS - 1)).astype(np.int64)


def run_counts(texts: DataFrame) -> np.ndarray:
    """How many runs of three of all texts fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for df in batches:
            total += np.bincount(bucket_of(runs_of_three(df["plain"].tolist())[1]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = texts.select("plain").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def some_of(texts: DataFrame) -> DataFrame:
    return texts.where(F.pmod(F.xxhash64("rep"), F.lit(EVERY)) == 0)


def splitters_of(sample: DataFrame, suffixes: int) -> np.ndarray:
    """First characters (k1) of the parts after the first, by the sampled suffixes."""
    parts = max(1, min(-(-suffixes // PART), PARTS))
    at = sample.select(F.percentile_approx("k1", [i / parts for i in range(1, parts)] or [0.5], 10 * PARTS).alias("at")).first()["at"]
    return np.unique(np.array(at if at and parts > 1 else [], np.int64))


def sorted_parts(array: DataFrame, suffixes: int, *order: str) -> DataFrame:
    """Every part in one task, sorted; tasks grow in number with the suffixes."""
    usual = int(array.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return array.repartition(max(usual, min(suffixes // TASK, TASKS)), "part").sortWithinPartitions("part", *order)


def rare_suffixes(counts, splitters: np.ndarray, grid: tuple[np.ndarray, np.ndarray], threshold: float):
    """The sparse array's suffixes: part, cell, first three characters, rep, kind, sketch, number of runs and place of this one.

    ``grid``: the first characters of the large intervals, sorted, and their cells on a side.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for df in batches:
            plain = df["plain"].tolist()
            row, run, _ = runs_of_three(plain)
            seen = often[bucket_of(run)]
            order = np.lexsort((run, seen, row))
            row, run = row[order], run[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
            row, run = row[new], run[new]
            n = np.bincount(row, minlength=len(plain))
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            odd = np.bincount(row * CLASSES + (mix(run) >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=len(plain) * CLASSES).reshape(len(plain), len(MARKS), 64) & 1
            marks = (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
            kept = place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]
            row, k1, place = row[kept], run[kept].view(np.int64), place[kept]
            rep, kind = df["rep"].to_numpy(np.int64), df["kind"].to_numpy(np.int64)
            out = {"part": np.searchsorted(splitters, k1, "right"), "cell": np.zeros(len(row), np.int64), "k1": k1, "kind": kind[row], "rep": rep[row], **{m: marks[row, k] for k, m in enumerate(MARKS)}, "runs": n[row] << 32 | place}
            yield pd.DataFrame(in_cells(out, grid)).astype({"part": np.int32, "cell": np.int32})

    return make


def in_cells(out: dict[str, np.ndarray], grid: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Suffixes of large intervals once for each cell of their row (evaluation) or column (training) of the grid."""
    heads, sides = grid
    if not len(heads) or not len(out["k1"]):
        return out
    near = np.minimum(np.searchsorted(heads, out["k1"]), len(heads) - 1)
    large = heads[near] == out["k1"]
    hot = np.flatnonzero(large)
    width = sides[near[hot]]
    own = (mix(out["rep"][hot].view(np.uint64)) % width.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(hot)), width)
    other = np.arange(len(again)) - (np.cumsum(width) - width)[again]
    more = {k: v[hot[again]] for k, v in out.items()}
    more["cell"] = 1 + np.where(more["kind"] & 1, own[again] * width[again] + other, other * width[again] + own[again])
    more["part"] = -1 - ((more["k1"] + more["cell"]) & 0xFFFF)  # parts of their own
    return {k: np.concatenate([v[~large], more[k]]) for k, v in out.items()}


RARE = "part int, cell int, k1 long, kind long, rep long, " + ", ".join(f"{m} long" for m in MARKS) + ", runs long"


def large_intervals(suffixes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Heads of the intervals of about CELL suffixes or more, by the suffixes of every EVERY-th text, and their cells on a side; one row for CELL suffixes at most."""
    heads = suffixes.groupBy("k1").agg(F.count("*").alias("n")).where(F.col("n") * EVERY >= CELL).orderBy("k1").toArrow().to_pandas()
    return heads["k1"].to_numpy(np.int64), -(-heads["n"].to_numpy(np.int64) * EVERY // CELL) + 1


def intervals(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted suffixes again, cut only between intervals of equal ``keys`` (of kinds, the table), and the number of the interval of each."""

    def begins(df: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(df), bool)
        for k in keys:
            v = df[k].to_numpy() >> 1 if k == "kind" else df[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    held: list[pd.DataFrame] = []
    for df in batches:
        if len(df):
            joint = pd.concat([held[-1][-1:], df]) if held else df
            at = np.flatnonzero(begins(joint)) - bool(held)
            if len(at):
                whole = pd.concat([*held, df[: at[-1]]], ignore_index=True)
                if len(whole):
                    yield whole, np.cumsum(begins(whole))
                held = []
            held.append(df[at[-1] :] if len(at) else df)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.cumsum(begins(whole))


def shared_spans(threshold: float, chunk: int = 1 << 20):
    """Scan of the sorted sparse suffixes: rep_eval, rep_train of both sides of an interval that can reach the likeness.

    Sides are sorted by numbers of runs.  Intervals of up to DENSE pairs are compared many at a time, pair by pair;
    larger ones in rectangles, of which only the training texts of fitting numbers of runs are touched, by two thirds
    of the classes first.
    """
    share = (1 - threshold) / (1 + threshold)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = np.empty(WIDE * HIGH, np.uint64), *(np.empty(WIDE * HIGH, np.uint8) for _ in range(2))
        for df, number in intervals(batches, "part", "k1", "cell", "kind"):
            kind, runs = df["kind"].to_numpy(np.int64), df["runs"].to_numpy(np.int64)
            order = np.lexsort((runs >> 32, kind & 1, number))
            number, kind, runs, rep = number[order], kind[order], runs[order], df["rep"].to_numpy(np.int64)[order]
            marks = [df[m].to_numpy(np.int64)[order].view(np.uint64) for m in MARKS]
            n, left = (runs >> 32).astype(np.int32), ((runs >> 32) - (runs & 0xFFFFFFFF)).astype(np.int32)

            def open_ones(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                both = n[a] + n[b]
                # s common runs of both = x + y - s at most: likeness <=> s * (1 + t) >= t * (x + y); at most ``left`` common ones from here on
                ok = np.flatnonzero(np.minimum(left[a], left[b]) * (1 + threshold) >= both * threshold - 1e-6)
                a, b, both = a[ok], b[ok], both[ok]
                apart = np.zeros(len(a), np.int32)
                for m in marks:
                    apart += np.bitwise_count(m[a] ^ m[b])
                ok = apart <= both * share + 1e-6
                return a[ok], b[ok]

            def frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
                return pd.DataFrame({"rep_eval": rep[a], "rep_train": rep[b], "kind": kind[a]}).drop_duplicates()

            is_eval = (kind & 1) == 1
            ev, tr = np.flatnonzero(is_eval), np.flatnonzero(~is_eval)
            low, high = np.searchsorted(number[tr], number[ev], "left"), np.searchsorted(number[tr], number[ev], "right")
            many = np.bincount(number[ev], minlength=number[-1] + 1)[number[ev]] * (high - low)
            small = (many > 0) & (many <= DENSE)
            some, first, width = ev[small], low[small], (high - low)[small]
            done, ends = 0, np.cumsum(width)
            while done < len(some):
                before = ends[done - 1] if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, before + chunk, "right")))
                i = np.repeat(np.arange(done, upto), width[done:upto])
                j = tr[first[i] + np.arange(len(i)) - (ends[i] - width[i] - before)]
                yield frame(*open_ones(some[i], j))
                done = upto
            large = np.flatnonzero(many > DENSE)
            heads = large[np.flatnonzero(np.diff(number[ev[large]], prepend=-1))]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at, to in zip(heads, np.searchsorted(number[ev], number[ev[heads]], "right"), strict=True):
                mine, theirs = ev[at:to], tr[low[at] : high[at]]
                for x in range(0, len(mine), HIGH):
                    a = mine[x : x + HIGH]
                    fit = np.searchsorted(n[theirs], [np.ceil(n[a[0]] * threshold - 1e-6), np.floor(n[a[-1]] / threshold + 1e-6) + 1])
                    for y in range(fit[0], fit[1], WIDE):
                        b = theirs[y : min(y + WIDE, fit[1])]
                        found.append(open_ones(*near_ones([m[a] for m in marks[:2]], [m[b] for m in marks[:2]], a, b, (int(n[a[-1]]) + int(n[b[-1]])) * share + 1e-6, work)))
                if sum(len(a) for a, _ in found) > chunk:
                    yield frame(*(np.concatenate(v) for v in zip(*found, strict=True)))
                    found = []
            if found:
                yield frame(*(np.concatenate(v) for v in zip(*found, strict=True)))

    return scan


def near_ones(mine: list[np.ndarray], theirs: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: float, work: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Members of a and b whose parities differ in at most ``most`` classes."""
    both, one, apart = (w[: len(a) * len(b)].reshape(len(a), len(b)) for w in work)
    for k, (x, y) in enumerate(zip(mine, theirs, strict=True)):
        np.bitwise_xor(x[:, None], y[None, :], out=both)
        np.bitwise_count(both, out=one if k else apart)
        if k:
            np.add(apart, one, out=apart)
    at = np.flatnonzero(apart.ravel() <= np.uint8(min(most, 255)))
    return a[at // len(b)], b[at % len(b)]


def cross_split_pairs(texts: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """tbl, rep_eval, rep_train, likeness of every pair of distinct texts (tbl, kind, rep, plain) of both sides that reaches the likeness."""
    counts = run_counts(texts)
    total = int(counts.sum())
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # 8 MB
    plain = texts.select("kind", "rep", "plain")
    none = np.zeros(0, np.int64)
    sample = stored(some_of(plain).mapInPandas(rare_suffixes(shared, none, (none, none), threshold), RARE).select("k1"), "p1-sample")
    suffixes = plain.mapInPandas(rare_suffixes(shared, splitters_of(sample, total), large_intervals(sample), threshold), RARE)
    array = sorted_parts(suffixes, total, "k1", "cell", "kind")
    met = stored(array.mapInPandas(shared_spans(threshold), "rep_eval long, rep_train long, kind long").distinct(), "p1-spans")
    train, ev = (F.col("kind").bitwiseAND(F.lit(1)) == side for side in (0, 1))
    left = texts.where(ev).select("tbl", "kind", F.col("rep").alias("rep_eval"), F.col("plain").alias("a"))
    right = texts.where(train).select("tbl", F.col("rep").alias("rep_train"), F.col("plain").alias("b"))
    read = met.join(left, ["rep_eval", "kind"]).join(right, ["tbl", "rep_train"])
    pairs = read.select("tbl", "rep_eval", "rep_train", likeness_of_plain("a", "b").alias("likeness")).where(F.col("likeness") >= threshold)
    short = texts.where("length(plain) < 3")
    equal = short.where(ev).select("tbl", "plain", F.col("rep").alias("rep_eval")).join(short.where(train).select("tbl", "plain", F.col("rep").alias("rep_train")), ["tbl", "plain"])
    return pairs.unionByName(equal.select("tbl", "rep_eval", "rep_train", F.lit(1.0).alias("likeness")))


WORDS = [f"k{j + 1}" for j in range(-(-SPAN // 3))]
FULL = "part int, " + ", ".join(f"{k} long" for k in WORDS) + ", kind long, rep long, at long"


def all_suffixes(splitters: np.ndarray):
    """The full array's suffixes of at least SPAN characters: part, first SPAN characters, kind, rep and position (of evaluation texts)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            codes, starts = to_codes(df["plain"].tolist())
            row = np.repeat(np.arange(len(df)), np.diff(starts))
            at = np.flatnonzero(np.arange(len(codes)) + SPAN <= starts[1:][row])
            row = row[at]
            words = {k: packed(codes, at + 3 * j, min(3, SPAN - 3 * j)) for j, k in enumerate(WORDS)}
            kind = df["kind"].to_numpy(np.int64)[row]
            ev = (kind & 1) == 1
            out = pd.DataFrame({"part": np.searchsorted(splitters, words["k1"], "right").astype(np.int32), **words, "kind": kind, "rep": np.where(ev, df["rep"].to_numpy(np.int64)[row], 0), "at": np.where(ev, at - starts[row], 0)})
            yield out.drop_duplicates()  # a training suffix counts once, wherever it stands

    return make


def packed(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n code points from each position on in the upper fields of a long, so that longs sort like texts."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out |= codes[at + k].astype(np.uint64) << np.uint64(42 - 21 * k)
    return out.view(np.int64)


def adjacent_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scan of the sorted full array: evaluation suffixes that have SPAN characters in common with the training suffix before them.

    Training suffixes stand before evaluation suffixes of the same first SPAN characters, so no other neighbour can share more.
    """
    last: pd.DataFrame | None = None  # the last training suffix before the batch
    for df in batches:
        if not len(df):
            continue
        joint = df if last is None else pd.concat([last, df], ignore_index=True)
        kind = joint["kind"].to_numpy(np.int64)
        before = np.maximum.accumulate(np.where((kind & 1) == 0, np.arange(len(joint)), -1))
        ev = np.flatnonzero(((kind & 1) == 1) & (before >= 0))
        near = before[ev]
        same = kind[ev] >> 1 == kind[near] >> 1
        for k in WORDS:
            word = joint[k].to_numpy(np.int64)
            same &= word[ev] == word[near]
        yield joint.loc[ev[same], ["kind", "rep", "at"]]
        if before[-1] >= 0:
            last = joint[before[-1] : before[-1] + 1]


def coverage(texts: DataFrame) -> DataFrame:
    """tbl, rep, coverage: of every distinct evaluation text, the share of its characters in the union of the spans it shares with training texts."""
    plain = texts.select("kind", "rep", "plain")
    total = int(texts.select(F.sum(F.length("plain"))).first()[0] or 0)
    splitters = splitters_of(some_of(plain).mapInPandas(all_suffixes(np.zeros(0, np.int64)), FULL), total)
    array = plain.mapInPandas(all_suffixes(splitters), FULL)
    array = sorted_parts(array.withColumn("tbl", F.shiftright("kind", 1)), total, "tbl", *WORDS, "kind").drop("tbl")
    spans = array.mapInPandas(adjacent_spans, "kind long, rep long, at long")
    earlier = F.lag("at").over(Window.partitionBy("kind", "rep").orderBy("at"))  # the positions of one text
    own = spans.select("kind", "rep", F.least(F.lit(SPAN), F.coalesce(F.col("at") - earlier, F.lit(SPAN))).alias("n")).groupBy("kind", "rep").agg(F.sum("n").alias("covered"))
    return texts.where(F.col("kind").bitwiseAND(F.lit(1)) == 1).join(own, ["kind", "rep"], "left").select("tbl", "rep", (F.coalesce("covered", F.lit(0)) / F.length("plain")).alias("coverage"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id_a < id_b: every pair of an evaluation and a training record with a likeness of at least 0.6."""
    texts, members = representatives(split_texts(spark, sf_dir))
    pairs = cross_split_pairs(texts)
    ev = members.where("side = 1").select("tbl", F.col("rep").alias("rep_eval"), F.col("id").alias("id_eval"))
    tr = members.where("side = 0").select("tbl", F.col("rep").alias("rep_train"), F.col("id").alias("id_train"))
    both = pairs.select("tbl", "rep_eval", "rep_train").join(ev, ["tbl", "rep_eval"]).join(tr, ["tbl", "rep_train"])
    return both.select("tbl", F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, evaluation split and source: records with a plain form, those like a training record, their links to distinct training texts, those contained in training spans, and the mean coverage."""
    texts, members = representatives(split_texts(spark, sf_dir))
    links = cross_split_pairs(texts).groupBy("tbl", F.col("rep_eval").alias("rep")).agg(F.count("*").alias("links"))
    each = members.where("side = 1").join(links, ["tbl", "rep"], "left").join(coverage(texts), ["tbl", "rep"])
    return each.groupBy("tbl", "split", "source").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("links") > 0).alias("leaked"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("train_texts"),
        F.count_if(F.col("coverage") >= CONTAINED).alias("contained"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )
