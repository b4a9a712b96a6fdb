"""Near duplicates of documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes
from graphloom.llm.blocks import paired_blocks, slices
from graphloom.operators.components import connected_components
from graphloom.storage import broadcast_if_small, discard, materialize

WORDS = 5  # words of a shingle
REGISTERS = 180
BANDS = 30  # of 6 registers each: a pair at 0.8 shares a band with probability 0.9999
MAYBE = 0.65  # share of equal registers below which a pair is not verified: 5 standard errors from 0.8, as weights are equal
LEADERS = 3
BLOCK = 2_000  # rows of a bucket that are compared in one task
CUT = 0.8
CHUNK_BYTES = 1 << 20  # text that a task hashes together

_MIX = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of every text, and where those of each text start.

    Words are what white space separates. A text with fewer words is one shingle, one
    without words has none. Word hashes are polynomials over bytes, taken from prefix sums."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.concatenate([[0], np.cumsum(size)])
    if not len(texts):
        return np.zeros(0, np.uint64), edge
    white = _WHITE[data]
    first = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    last = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[data] * powers[:-1], dtype=np.uint64)])
    back = np.full(len(data) + 1, np.uint64(_inverse(int(_BASE))), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    word = _scramble((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    text_of = np.searchsorted(edge, first, side="right") - 1
    per = np.bincount(text_of, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(per)])
    rolled = word.copy()
    for k in range(1, words):
        m = max(0, len(word) - k)
        rolled[:m] = rolled[:m] * np.uint64(0xD6E8FEB86659FD93) + word[k:]
    rolled = _scramble(rolled)
    within = np.arange(len(word)) - begin[text_of]
    keep = within + words <= per[text_of]
    short = (per > 0) & (per < words)
    if short.any():  # the words of a short text together
        fold = np.zeros(len(texts), np.uint64)
        for k in range(words - 1):
            has = short & (per > k)
            fold[has] = fold[has] * np.uint64(0xA0761D6478BD642F) + word[begin[:-1][has] + k]
        rolled[begin[:-1][short]] = _scramble(fold[short])
        keep[begin[:-1][short]] = True
    count = np.bincount(text_of[keep], minlength=len(texts))
    return rolled[keep], np.concatenate([[0], np.cumsum(count)])


def signatures(hashes: np.ndarray, starts: np.ndarray, registers: int = REGISTERS, weighted: bool = True) -> np.ndarray:
    """ProbMinHash signatures, a row per text: register r holds the shingle whose Poisson process,
    of a rate equal to its weight, is the first to arrive at r.

    Weights are 1 + ln(occurrences), or 1 where not ``weighted``: registers are then equal with the
    probability of the Jaccard similarity of the sets. All shingles of all texts make their next arrival together;
    a shingle ends as soon as its time passes the latest register of its text, so that after the
    first round only the few early ones go on."""
    texts = len(starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(starts))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.concatenate([at, [len(h)]]))) if weighted else np.ones(len(at))
    h, o = h[at], o[at]
    best = np.full((texts, registers), np.inf)
    who = np.zeros((texts, registers), np.uint64)
    time = np.zeros(len(h))
    live = np.arange(len(h))
    state = _scramble(h + np.uint64(0x5851F42D4C957F2D))
    while len(live):
        s = _scramble(state[live] + _BASE)
        state[live] = s
        u = ((s >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        time[live] -= np.log(u) / weight[live]
        slot = (_scramble(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(registers)).astype(np.int64)
        cell = o[live] * registers + slot
        flat = best.ravel()
        before = flat[cell]
        wins = time[live] < before
        np.minimum.at(flat, cell[wins], time[live][wins])
        won = wins & (flat[cell] == time[live])
        who.ravel()[cell[won]] = h[live[won]]
        latest = best.max(1)
        live = live[time[live] < latest[o[live]]]
    return who


def _chunks(batch, column: str):
    """Slices of a batch with a bounded amount of text (one row at least)."""
    texts = [t or b"" for t in batch[column]]
    at, used = 0, 0
    for i, t in enumerate(texts):
        if used and used + len(t) > CHUNK_BYTES:
            yield at, i, texts[at:i]
            at, used = i, 0
        used += len(t)
    if at < len(texts):
        yield at, len(texts), texts[at:]


def _banded(batches):
    rows = REGISTERS // BANDS
    for batch in batches:
        for s, e, texts in _chunks(batch, "text"):
            hashes, starts = shingle_hashes(texts)
            who = signatures(hashes, starts, weighted=False)  # links are of sets: occurrences must not part them
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(rows):
                bands = bands * np.uint64(0x9FB21C651E98DF25) + _scramble(who[:, k::rows])
            bands = _scramble(bands + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            some = np.flatnonzero(np.diff(starts) > 0)
            low = _scramble(who).astype(np.uint8)
            yield pd.DataFrame({
                "id": batch["id"].iloc[s:e].iloc[some], "bands": list(bands[some]), "sketch": [x.tobytes() for x in low[some]],
            })


def _sets(batches):
    for batch in batches:
        for s, e, texts in _chunks(batch, "text"):
            hashes, starts = shingle_hashes(texts)
            hashes = (hashes >> np.uint64(32)).astype(np.uint32)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pd.DataFrame({"id": batch["id"].iloc[s:e], "shingles": sets})


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _plausible(batches):
    """Pairs (a, b) whose sketches, of a byte per register, do not rule out the similarity."""
    for batch in batches:
        if batch.num_rows:
            keep = pa.array((_bytes(batch["a_sketch"]) == _bytes(batch["b_sketch"])).mean(1) >= MAYBE)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])


def _rivals(part: pa.Table):
    """(x, others, shares): rows of a bucket (or two of its blocks) with plausible partners of other
    classes, the likest first; every pair once."""
    i, j = part["i"][0].as_py(), part["j"][0].as_py()
    kind, block = part["class"].to_numpy(), part["block"].to_numpy()
    sketch = _bytes(part["sketch"])
    right = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        others = right[(kind[right] != kind[x]) & ((right > x) if i == j else True)]
        if len(others):
            share = (sketch[others] == sketch[x]).mean(1)
            near = np.argsort(-share, kind="stable")[: int((share >= MAYBE).sum())]
            if len(near):
                yield x, others[near]


def _flag(batches):
    """Ids that have a plausible partner of another class in their bucket."""
    for _, table, s, e in slices(batches, ("bucket", "i", "j")):
        part = table.slice(s, e - s)
        found = np.zeros(part.num_rows, bool)
        for x, others in _rivals(part):
            found[x] = True
            found[others] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(part["id"].to_numpy()[found], pa.int64())], ["id"])


def similarity(p: np.ndarray, q: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 0 where their sizes alone rule out the threshold."""
    if not len(p) or not len(q) or min(len(p), len(q)) < CUT * max(len(p), len(q)):
        return 0.0
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(p) + len(q) - common)


def _confirm(batches):
    """Links that join classes within a bucket: a pair is verified on its sets unless links found
    before it join its classes already, so at most one link per member goes on."""
    for _, table, s, e in slices(batches, ("bucket", "i", "j")):
        part = table.slice(s, e - s)
        ids, kind = part["id"].to_numpy(), part["class"].to_numpy().tolist()
        sets = [np.frombuffer(v, np.uint32) for v in part["shingles"].to_pylist()]
        root = {k: k for k in kind}

        def find(k, root=root):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        found = []
        for x, others in _rivals(part):
            for y in others:
                if find(kind[x]) != find(kind[y]) and similarity(sets[x], sets[y]) >= CUT:
                    root[find(kind[x])] = find(kind[y])
                    found.append((int(ids[x]), int(ids[y])))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _jaccard(batches):
    for batch in batches:
        a, b = ([np.frombuffer(v, np.uint32) for v in batch[c].to_pylist()] for c in ("a_set", "b_set"))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(list(map(similarity, a, b)), pa.float64())], ["a", "b", "jaccard"])


def shingle_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingles) of the given ids, as sorted 32-bit hashes; of the shingles of two texts of
    a thousand words two collide once in 2000 pairs."""
    return texts.join(broadcast_if_small(ids, 1_000_000), "id", "left_semi").mapInPandas(_sets, "id bigint, shingles binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, jaccard): similarity of both sides of every pair, on their whole shingle sets."""
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "minhash-ids")
    sets = materialize(shingle_sets(wanted, texts), "minhash-sets")
    discard(wanted)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
    return both.mapInArrow(_jaccard, "a bigint, b bigint, jaccard double")


def _leaders(rank: str):
    """The best ``rank`` of a bucket; partial sums first, so that a hot bucket is no single task."""
    return F.min_by("id", F.struct(F.col(rank), F.col("id"))).alias(rank)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): the class of every document by links of Jaccard similarity of at least
    0.8 on sets of five words (lower case); class_id is the smallest id of the class.

    Equal texts are one first, under their smallest id. In every bucket all members are paired
    with three leaders (smallest id and two hashed orders), so pairs grow with members, and links
    that the sets confirm make classes. Within buckets that then hold several classes, members of
    different classes are compared by their sketches, in blocks, and the plausible pairs confirmed on
    their sets where they lie. Registers are those of sets, as are links: a pair at 0.8 shares no band once in
    9000 pairs, and of pairs that share one, sketches rule out fewer than one in a million. Null, empty
    and wordless texts are classes of their own, as are rows without id (class null); rows that
    repeat an id are in one class. Extra columns are ignored, an empty table gives no rows."""
    base = by_bytes(docs).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    worded = F.col("text").rlike(r"\S") & F.col("id").isNotNull()
    member = materialize(base.select("id", F.when(worded, F.unhex(F.md5("text"))).alias("h")), "minhash-members")
    first = member.where("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = materialize(first.where("n > 1").select("h", "rep"), "minhash-copies")
    skip = materialize(
        member.join(broadcast_if_small(copies, 300_000), "h").where("id <> rep").select("id").distinct(), "minhash-skip"
    )
    raw = base.where(worded).select("id", F.encode(F.lower("text"), "UTF-8").alias("text"))
    texts = raw.join(broadcast_if_small(skip, 1_000_000), "id", "left_anti")
    signs = materialize(texts.mapInPandas(_banded, "id bigint, bands array<bigint>, sketch binary").dropDuplicates(["id"]), "minhash-signs")
    rows = signs.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    full = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "minhash-full")
    shared = materialize(rows.join(broadcast_if_small(full, 1_000_000), "bucket", "left_semi"), "minhash-shared")

    orders = [F.col("id"), *[F.xxhash64(F.col("id"), F.lit(k)) for k in range(1, LEADERS)]]
    best = [F.min_by("id", F.struct(r, F.col("id"))) for r in orders]
    leads = shared.groupBy("bucket").agg(F.array_distinct(F.array(*best)).alias("leads"))
    led = shared.join(leads, "bucket").select("id", F.explode("leads").alias("lead")).where("id <> lead")
    pairs = materialize(led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "minhash-led")
    side = lambda c: signs.select(F.col("id").alias(c), F.col("sketch").alias(f"{c}_sketch"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_plausible, "a bigint, b bigint")
    links = verify(materialize(likely, "minhash-likely"), raw)
    links = materialize(links.where(F.col("jaccard") >= CUT).select("a", "b"), "minhash-links")
    groups = materialize(connected_components(links, "a", "b"), "minhash-groups")

    named = shared.join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class"))
    mixed = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"))
    # the leaders were compared with all: with one more member nothing is left
    mixed = materialize(mixed.where((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("bucket"), "minhash-mixed")
    named = named.join(broadcast_if_small(mixed, 1_000_000), "bucket", "left_semi")
    order = ["bucket", "i", "j"]

    def blocked(rows: DataFrame, *more: str) -> DataFrame:
        wide = paired_blocks(named.join(rows.select("id"), "id", "left_semi"), ["bucket"], F.col("id"), BLOCK, "minhash-hot")
        wide = wide.join(rows, "id").select(*order, "block", "id", "class", "sketch", *more)
        return wide.repartition(*order).sortWithinPartitions(*order)

    flagged = materialize(blocked(signs.select("id", "sketch")).mapInArrow(_flag, "id bigint").distinct(), "minhash-flagged")
    rivals = signs.select("id", "sketch").join(shingle_sets(flagged, raw), "id")
    more = materialize(blocked(rivals, "shingles").mapInArrow(_confirm, "a bigint, b bigint"), "minhash-more")
    if not more.isEmpty():
        groups = materialize(connected_components(links.unionByName(more), "a", "b"), "minhash-groups")
    named = member.join(broadcast_if_small(copies, 300_000), "h", "left").withColumn("rep", F.coalesce("rep", "id"))
    known = groups.select(F.col("id").alias("rep"), "component")
    out = named.join(broadcast_if_small(known, 1_000_000), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("class_id"))
