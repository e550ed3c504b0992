"""Periodic runs: stretches of words that repeat with one period, three times or more.

Detection is by block convolution. At each dyadic scale B = 8, 16, 32, ... the words are cut into aligned
blocks of B, and each block is sought in the windows that follow it: words become small integers, and the
sum of squared differences between a block and every place of its window comes from one number-theoretic
transform. Values are so small that a sum never reaches the modulus, so the residue is the sum itself
and zero means no mismatch. A run of period q holds at least two blocks and a period more than the block
of its scale, hence some aligned block recurs in it at distance q. Such a distance is only a seed: the
seed is compared on the words themselves and extended both ways, so hashing never decides a result.

Seeds inside a known run whose period divides their distance are passed over, which keeps texts that
repeat one word throughout from being extended at every distance.

Documents are independent, so nothing is shuffled; a task works on ``CHUNK`` words or one document at a
time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and least number of its periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that a task works on together.
CHUNK = 1 << 18
#: Modulus 7 * 2**20 + 1 and a generator: sums of 64 products stay below 2**53, exact in floating point.
PRIME, GENERATOR = 7_340_033, 3
RADIX, FIRST_BLOCK, LAST_BLOCK = 64, 8, 1 << 19
#: Cells of one transform step.
CELLS = 1 << 18

BLANK = r"[\x20\x09-\x0D]+"


def _reduced(x):
    """``x`` modulo the prime, up to one multiple at the rims."""
    import numpy as np

    return x - np.floor(x * (1.0 / PRIME)) * PRIME


@lru_cache(maxsize=64)
def _powers(n: int, rows: int, columns: int, inverse: bool):
    """``rows`` x ``columns`` matrix of w ** (i * j) for a root w of unity of order ``n``."""
    import numpy as np

    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    table = np.empty(n, dtype=np.int64)
    table[0] = 1
    have = 1
    while have < n:  # doubles the known powers
        more = min(have, n - have)
        table[have : have + more] = table[:more] * pow(root, have, PRIME) % PRIME
        have += more
    return table[np.outer(np.arange(rows), np.arange(columns)) % n].astype(np.float64)


def transform(x, inverse: bool = False):
    """Number-theoretic transform of every row of ``x`` (length a power of two).

    The forward transform leaves its values in the mixed-radix order that the inverse expects. The
    inverse does not divide by the length.
    """
    n = x.shape[1]
    if n <= RADIX:
        return _reduced(x @ _powers(n, n, n, inverse))
    inner = n // RADIX
    cube, twiddle = x.reshape(-1, RADIX, inner), _powers(n, RADIX, inner, inverse)
    outer = _powers(RADIX, RADIX, RADIX, inverse)
    if not inverse:
        cube = _reduced(_reduced(outer @ cube) * twiddle)
        return transform(cube.reshape(-1, inner)).reshape(-1, n)
    cube = transform(x.reshape(-1, inner), True).reshape(-1, RADIX, inner)
    return _reduced(outer @ _reduced(cube * twiddle)).reshape(-1, n)


def squared_differences(blocks, windows):
    """Sums of squared differences between each block (B values) and every place 0..B of its window (2B values).

    Exact as long as B times the largest squared value is below the prime.
    """
    import numpy as np

    size = blocks.shape[1]
    padded = np.zeros((len(blocks), 2 * size))
    padded[:, :size] = blocks[:, ::-1]
    product = transform(_reduced(transform(padded) * transform(windows)), True)
    product = _reduced(product * float(pow(2 * size, PRIME - 2, PRIME)))[:, size - 1 :]
    product += PRIME * (product < 0)
    product -= PRIME * (product >= PRIME)
    sums = np.concatenate([np.zeros((len(windows), 1)), np.cumsum(windows * windows, axis=1)], axis=1)
    return (blocks * blocks).sum(axis=1)[:, None] + (sums[:, size:] - sums[:, : size + 1]) - 2 * product


def _scales(longest: int) -> Iterator[tuple[int, int]]:
    """(block, k): blocks of that size are sought at distances in (k * block, (k + 1) * block]."""
    block, k = FIRST_BLOCK, 0
    while k * block < longest // LEAST_PERIODS:
        yield block, k
        if k == 0 or block == LAST_BLOCK:
            k += 1
        else:
            block *= 2


def _seeds(words, low, high, block: int, k: int):
    """Places and distances of all blocks that recur in their window, by hashed values."""
    import numpy as np

    starts = np.arange(0, len(words) - block + 1, block)
    end = high[starts]
    fits = (starts + 2 * block + k * block <= end + block - 1) & (starts + block <= end)
    fits &= end - low[starts] >= max(LEAST_WORDS, LEAST_PERIODS * (k * block + 1))
    starts = starts[fits]
    values = int(((PRIME - 1) / block) ** 0.5)
    hashed = ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(values)
    hashed = np.concatenate([hashed.astype(np.float64), np.zeros((k + 3) * block)])
    view = np.lib.stride_tricks.sliding_window_view
    found_at, found_by = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = max(1, CELLS // (2 * block))
    for a in range(0, len(starts), rows):
        part = starts[a : a + rows]
        sums = squared_differences(view(hashed, block)[part], view(hashed, 2 * block)[part + k * block])
        row, lag = np.nonzero(sums[:, 1:] == 0)
        at, by = part[row], lag + 1 + k * block
        inside = at + block + by <= high[at]
        found_at.append(at[inside])
        found_by.append(by[inside])
    return np.concatenate(found_at), np.concatenate(found_by)


def _matching(a, b) -> int:
    """How many leading values of ``a`` and ``b``, equally long, are the same."""
    import numpy as np

    done, step = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return len(a)


def find_runs(words, bounds) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start, then period, in documents that ``bounds`` cuts from ``words``.

    ``words`` are integers, equal for equal words; document i is ``words[bounds[i]:bounds[i + 1]]``. Starts
    count from the beginning of ``words``.
    """
    import numpy as np

    sizes = np.diff(bounds)
    low, high = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    until, period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)  # of the known run that reaches furthest
    runs = []
    for block, k in _scales(int(sizes.max(initial=0))):
        at, by = _seeds(words, low, high, block, k)
        known = (until[at] >= at + by + np.maximum(block, period[at])) & (by % period[at] == 0)
        at, by = at[~known], by[~known]
        order = np.lexsort((at, by))
        left = right = distance = -1
        for s, d in zip(at[order].tolist(), by[order].tolist()):
            if d == distance and left <= s and s + d + block <= right:
                continue
            if until[s] >= s + d + max(block, period[s]) and d % period[s] == 0:
                continue
            first, last = int(low[s]), int(high[s])
            ahead = _matching(words[s : last - d], words[s + d : last])
            if ahead < block:
                continue
            behind = _matching(words[first:s][::-1], words[first + d : s + d][::-1])
            left, right, distance = s - behind, s + ahead + d, d
            if right - left < max(LEAST_WORDS, LEAST_PERIODS * d) or (until[left] >= right and d % period[left] == 0):
                continue
            runs.append((left, right - left, d))
            shorter = np.arange(left, right)[until[left:right] < right]
            until[shorter], period[shorter] = right, d
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, words) in lists of up to ``CHUNK`` words, one row at least."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]
    types = [pa.int64(), pa.int64(), pa.list_(one), pa.string()]
    for batch in batches:
        rows = ((doc.as_py(), (text.as_py() or b"").split()) for doc, text in zip(batch.column(0), batch.column(1), strict=True))
        for chunk in _chunks(rows):
            bounds = np.cumsum([0, *[len(words) for _, words in chunk]])
            every = pa.array([w for _, words in chunk for w in words], pa.binary())
            codes = every.dictionary_encode().indices.to_numpy() if len(every) else np.empty(0, np.int32)
            keep = np.ones(len(codes), bool)
            of_doc: list[list[dict]] = [[] for _ in chunk]
            found = find_runs(codes, bounds)
            owners = np.searchsorted(bounds, [r[0] for r in found], side="right") - 1
            for (start, length, period), owner in zip(found, owners.tolist()):
                keep[start + period : start + length] = False
                of_doc[owner].append({"start": start - int(bounds[owner]), "length": length, "period": period})
            kept = [
                b" ".join(words if not runs else [w for w, k in zip(words, keep[a : a + len(words)].tolist()) if k]).decode("utf-8", "replace")
                for (_, words), runs, a in zip(chunk, of_doc, bounds.tolist())
            ]
            columns = [[doc for doc, _ in chunk], [len(words) for _, words in chunk], of_doc, kept]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text.

    Words are what blanks (space, tab to carriage return) part, numbered from 0. A run is a stretch with
    smallest period q, of at least 24 words and 3 q, that no neighbouring word extends. The collapsed text
    holds the words that lie in no run after its first q words, joined by one space. A null, empty or
    blank text has no words, no runs and an empty collapsed text. Rows are independent: repeated rows
    and null ids give rows of their own. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_detect, schema)


def planted_text(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten (by the checksum of its id) with a tail that repeats its first words; others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        repeated = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), repeated), " ")).otherwise(text)

    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), tail), F.lit(0))).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """``found`` (of ``periodic_runs``) with one row per document: number of runs, the one of greatest exponent, and digests."""

    def better(x: Column, y: Column) -> Column:
        """Order by exact exponent, greatest first, then start and period."""
        lead = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(lead != 0, F.signum(lead)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
            F.signum(x["period"] - y["period"])).cast("int")

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    best = found.withColumn("best", F.get(F.array_sort("runs", better), F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
