"""Words of text that is written without blanks: a lexicon learnt from the text itself, and the best path through it.

A lexicon is learnt from counted runs of signs: a word's parts stand together more often than by chance
(cohesion), and many signs stand before and after it (boundary entropy). To segment, every lexicon word in a run of signs is
an edge of a word graph; the path with the greatest probability is the segmentation. Signs are found on the bytes of many texts at
once, grams are counted as numbers, and the runs of a slice of texts take their steps together. A lexicon of up to a million words is
broadcast, and texts are segmented where they lie. A greater one may be of any size: chunks of distinct runs get their costs by one join
of substrings with the lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators.best import stored
from ragloom.operators.token_arrays import is_lead, text_slices

#: The signs that are written without blanks, and everything that a token is made of.
SIGNS = "[一-鿿]+"
PIECES = "[a-z0-9]+|[一-鿿]+"
#: Probabilities are kept as whole millionths of a nat, so sums don't depend on their order.
SCALE = 1_000_000
#: Distinct grams that a task holds before it passes them on, and signs of the runs that are solved together.
GRAMS_HELD, CHUNK_SIGNS = 1 << 18, 1 << 17
#: Words of a lexicon that is broadcast, bytes of the texts that are segmented together, and cells of a table that finds words' next signs.
HELD_WORDS, SEGMENT_BYTES, TABLE_CELLS = 1 << 20, 1 << 21, 1 << 22
#: Signs are numbered from 2 on; 0 is nothing and 1 is the start or end of a run.
FIRST_SIGN, SIGN_NUMBERS = 0x4E00, 0x9FFF - 0x4E00 + 3
#: More than any path costs.
_NEVER = 1 << 55


def pieces(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and whole runs of signs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(PIECES), F.lit(0))


def _signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signs of texts: the byte each begins at, its number, and whether it begins a run."""
    lead = np.flatnonzero(is_lead(data))
    number = ((data[lead].astype(np.int64) & 15) << 12) + ((data[lead + 1].astype(np.int64) & 63) << 6) + (data[lead + 2] & 63) - FIRST_SIGN + 2
    begins = np.ones(len(lead), bool)
    begins[1:] = lead[1:] != lead[:-1] + 3
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text doesn't go on with the one before
    return lead, number, begins | first[lead]


class _Grams:
    """Counts of grams as numbers of ``longest`` digits, each the place of a sign among those that were seen; 0 follows the end of a run."""

    def __init__(self, longest: int):
        self.longest, self.base = longest, int(2 ** (62.9 / longest))
        self.clear()

    def clear(self) -> None:
        self.place, self.seen, self.held, self.size = np.zeros(SIGN_NUMBERS, np.int64), np.zeros(1, np.int64), [], 0

    def add(self, number: np.ndarray, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(begins) - 1
        runs = int(run[-1]) + 1
        row = np.zeros(len(number) + 3 * runs, np.int64)
        at = np.arange(len(number)) + 3 * run + 1
        row[at] = number
        row[at[begins] - 1] = 1
        row[at[np.append(begins[1:], True)] + 1] = 1
        used = np.flatnonzero(np.bincount(row, minlength=SIGN_NUMBERS))[1:]
        new = used[self.place[used] == 0]
        if len(self.seen) + len(new) > self.base:
            yield from self.told()
            new = used
        if len(new) >= self.base:  # too many signs for one number
            yield from self._wide(row)
            return
        self.place[new] = len(self.seen) + np.arange(len(new))
        self.seen = np.append(self.seen, new)
        row = self.place[row]
        code, last = row, row
        for k in range(1, self.longest):
            last = np.where(last[: len(row)] > 0, np.append(row[k:], np.zeros(k, np.int64)), 0)
            code = code * self.base + last
        code, n = np.unique(code[row > 0], return_counts=True)
        self.held.append((code, n))
        self.size += len(code)
        if self.size > 2 * GRAMS_HELD:
            self._merge()
            if self.size > GRAMS_HELD:
                yield from self.told()

    def _merge(self) -> None:
        code, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.held, self.size = [(code[first], np.add.reduceat(n[order], first))], len(first)

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            code, n = self.held[0]
            digits = np.empty((len(code), self.longest), np.int64)
            for k in range(self.longest - 1, -1, -1):
                code, digits[:, k] = np.divmod(code, self.base)
            yield from self._grams(self.seen[digits], n)
        self.clear()

    def _wide(self, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        digits = np.zeros((len(row), self.longest), np.int32)
        digits[:, 0] = code = row
        size = SIGN_NUMBERS
        for k in range(1, self.longest):
            digits[: len(row) - k, k] = np.where(digits[: len(row) - k, k - 1] > 0, row[k:], 0)
            if size * SIGN_NUMBERS >= 1 << 62:
                seen, code = np.unique(code, return_inverse=True)
                size = len(seen)
            code, size = code * SIGN_NUMBERS + digits[:, k], size * SIGN_NUMBERS
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        held = row[first] > 0
        yield from self._grams(digits[first[held]].astype(np.int64), n[held])

    def _grams(self, digits: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The grams of all sizes, from sorted rows of the longest: grams with the same start stand together."""
        points = np.where(digits == 1, ord("$"), digits + FIRST_SIGN - 2).astype(np.uint32)
        differs = np.zeros(len(n), bool)
        differs[:1] = True
        for k in range(1, self.longest + 1):
            differs[1:] |= digits[1:, k - 1] != digits[:-1, k - 1]
            first = np.flatnonzero(differs)
            whole = digits[first, k - 1] > 0
            grams = np.ascontiguousarray(points[first[whole], :k]).view(f"<U{k}").ravel()
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.add.reduceat(n, first)[whole], pa.int64())], ["gram", "n"])


def sign_grams(texts: DataFrame, longest: int, text_col: str = "content") -> DataFrame:
    """``gram, n``: all runs of up to ``longest`` signs, overlaps included; ``$`` stands for the start or end of a run. Tasks count
    the grams of their texts before these are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(longest)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                _, number, begins = _signs(data, offsets)
                if len(number):
                    yield from grams.add(number, begins)
        yield from grams.told()

    return texts.select(text_col).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_lexicon(texts: DataFrame, text_col: str = "content", longest: int = 4, min_count: int = 5, min_cohesion: float = 2.0, min_entropy: float = 0.7) -> DataFrame:
    """``word, n, cohesion, entropy`` of the words of two to ``longest`` signs.

    ``cohesion``: of all ways to cut a word in two, the least log ratio of its probability to the product of those of its parts;
    ``entropy``: the lesser of the entropies, in nats, of the sign after it and the sign before it, the end
    of a run being a sign of its own. Both are rounded to six places. Null texts and texts without signs teach nothing."""
    grams = stored(sign_grams(texts, longest + 1, text_col).where("gram <> '$'"), "grams")
    inner = grams.where(~F.contains("gram", F.lit("$")))
    total = F.broadcast(inner.where(F.char_length("gram") == 1).agg(F.sum("n").alias("total")))
    words = inner.where((F.col("n") >= min_count) & F.char_length("gram").between(2, longest)).withColumnRenamed("gram", "word")
    cut = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1))
    cuts = words.withColumn("k", cut).select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("head"), F.substring("word", F.col("k") + 1, F.char_length("word")).alias("tail"))
    part = lambda name, n: inner.select(F.col("gram").alias(name), F.col("n").alias(n))
    both = cuts.join(part("head", "n_head"), "head").join(part("tail", "n_tail"), "tail").crossJoin(total)
    ratio = F.log(F.col("n").cast("double")) + F.log(F.col("total").cast("double")) - F.log(F.col("n_head").cast("double")) - F.log(F.col("n_tail").cast("double"))
    firm = both.groupBy("word", "n").agg(F.round(F.min(ratio), 6).alias("cohesion")).where(F.col("cohesion") >= min_cohesion)
    size = F.char_length("gram")
    wide = grams.where(size > 2)
    beside = wide.select(F.substring("gram", F.lit(1), size - 1).alias("word"), F.lit("after").alias("side"), "n").unionByName(
        wide.select(F.substring("gram", F.lit(2), size - 1).alias("word"), F.lit("before").alias("side"), "n")
    )
    n = F.col("n").cast("double")
    free = beside.where(~F.contains("word", F.lit("$"))).groupBy("word", "side").agg(F.round(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n), 6).alias("h"))
    free = free.groupBy("word").agg((F.min("h") + F.lit(0.0)).alias("entropy")).where(F.col("entropy") >= min_entropy)
    return firm.join(free, "word")


def weighed(lexicon: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``word, cost``: each word's negative log probability in millionths, from ``(word, n)``; ``extra`` words (word, n) are taken with
    their counts, or what the lexicon has if that is more."""
    rows = lexicon.select("word", "n") if extra is None else lexicon.select("word", "n").unionByName(extra.select("word", "n"))
    rows = rows.where("n > 0").groupBy("word").agg(F.max("n").alias("n"))
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))
    cost = F.round((F.log(F.col("total").cast("double") + 1) - F.log(F.col("n").cast("double"))) * SCALE).cast("long")
    return rows.crossJoin(total).select("word", cost.alias("cost"))


def best_path(length: int, edges: list[tuple[int, int, int]], alone: int) -> list[int]:
    """Where the words of the cheapest path through a run end. ``edges``: (end, size, cost) sorted; a sign alone costs ``alone``
    unless an edge says otherwise. Of equal paths the one with the longest last word is taken, and so on to the front."""
    best, back = [0] * (length + 1), [0] * (length + 1)
    at = 0
    for end in range(1, length + 1):
        best[end], back[end] = best[end - 1] + alone, 1
        while at < len(edges) and edges[at][0] == end:
            _, size, cost = edges[at]
            if best[end - size] + cost < best[end] or (best[end - size] + cost == best[end] and size > back[end]) or (size == 1 and back[end] == 1):
                best[end], back[end] = best[end - size] + cost, size
            at += 1
    ends = []
    while length:
        ends.append(length)
        length -= back[length]
    return ends[::-1]


def segment_runs(runs: DataFrame, costs: DataFrame, longest: int = 4) -> DataFrame:
    """``run, words, subwords`` of distinct runs of signs, ``(run)``; ``costs``: (word, cost) of ``weighed``. ``subwords`` are the
    words of two and three signs inside longer ones of the path, as a search wants them, each before the word that holds it.

    Runs are dealt into chunks of a bounded number of signs, and each chunk gets the costs of the words that stand in its runs."""
    runs = stored(runs.select("run").distinct(), "runs")
    costs = stored(costs.select("word", "cost"), "costs")
    dear = costs.agg(F.max("cost")).first()[0]
    alone = (dear or SCALE) * 2  # an unknown sign is dearer than any word
    signs = runs.agg(F.sum(F.char_length("run"))).first()[0] or 0
    dealt = runs.select(F.pmod(F.xxhash64("run"), F.lit(-(-signs // CHUNK_SIGNS) or 1)).alias("chunk"), "run")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: set[tuple[int, str]] = set()
            for last, (chunk, run) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1):
                for size in range(1, longest + 1):
                    held.update([(chunk, run[i : i + size]) for i in range(len(run) - size + 1)])
                if len(held) > GRAMS_HELD or last == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([w for _, w in held], pa.string())], ["chunk", "word"])
                    held.clear()

    known = dealt.mapInArrow(spans, "chunk long, word string").distinct().join(costs, "word").select("chunk", "word", "cost")

    def solve(own: pa.Table, known: pa.Table) -> pa.Table:
        cost = dict(zip(known.column("word").to_pylist(), known.column("cost").to_pylist(), strict=True))
        texts, words, inside = own.column("run").to_pylist(), [], []
        for text in texts:
            held = [(e, s, cost[text[e - s : e]]) for e in range(1, len(text) + 1) for s in range(1, min(e, longest) + 1) if text[e - s : e] in cost]
            found = {(e, s) for e, s, _ in held}
            ends = best_path(len(text), held, alone)
            path = list(zip([0, *ends], ends, strict=False))
            words.append([text[a:b] for a, b in path])
            inside.append([[text[e - s : e] for s in (2, 3) if s < b - a for e in range(a + s, b + 1) if (e, s) in found] for a, b in path])
        return pa.table([pa.array(texts, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.list_(pa.string())))], ["run", "words", "subwords"])

    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(solve, "run string, words array<string>, subwords array<array<string>>")


class _Words:
    """A lexicon as arrays: the words' starts of each size are numbered, and a start and its next sign give the next start."""

    def __init__(self, words: pa.Array, costs: pa.Array, longest: int, alone: int):
        """``words`` that are of other signs or too long are left out, as no run holds them."""
        text, cost = words.to_pylist(), costs.to_numpy()
        held = [i for i, w in enumerate(text) if w and len(w) <= longest and FIRST_SIGN <= min(map(ord, w)) and max(map(ord, w)) <= 0x9FFF]
        size = np.array([len(text[i]) for i in held], np.int64)
        cost, longest = cost[held], int(size.max(initial=1))
        digits = np.zeros((len(held), longest), np.int64)
        joined = np.frombuffer("".join([text[i] for i in held]).encode("utf-32-le"), np.uint32).astype(np.int64)
        digits[np.arange(longest) < size[:, None]] = joined - FIRST_SIGN + 2
        signs = np.unique(joined) - FIRST_SIGN + 2
        self.place, self.signs = np.zeros(SIGN_NUMBERS, np.int64), len(signs) + 1
        self.place[signs] = np.arange(1, self.signs)
        digits = self.place[digits]
        start, self.keys, self.costs, self.entry = digits[:, 0], [np.arange(self.signs)], [], []
        signs = [chr(c) for c in range(FIRST_SIGN, FIRST_SIGN + SIGN_NUMBERS - 2)]
        self.texts = pa.array(signs + [text[i] for i in held], pa.large_string())
        for k in range(1, longest + 1):
            if k > 1:
                key = np.where(digits[:, k - 1] > 0, start * self.signs + digits[:, k - 1], 0)
                self.keys.append(np.unique(np.append(key, 0)))
                start = np.searchsorted(self.keys[-1], key)
            told = np.full(len(self.keys[-1]), alone if k == 1 else _NEVER, np.int64)
            told[start[size == k]] = cost[size == k]
            self.costs.append(told)
            entry = np.zeros(len(told), np.int32)
            entry[start[size == k]] = len(signs) + np.flatnonzero(size == k)
            self.entry.append(entry)

    def prepare(self) -> None:
        """Tables for the steps from one size to the next where these are small."""
        self.tables = []
        for k in range(1, len(self.keys)):
            cells = len(self.keys[k - 1]) * self.signs
            table = np.zeros(cells, np.int32) if cells <= TABLE_CELLS else None
            if table is not None:
                table[self.keys[k]] = np.arange(len(self.keys[k]))
            self.tables.append(table)

    def edges(self, number: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The cost of the word of each size from each sign on, and its place among the starts; ``left``: signs up to the end of its run."""
        place = self.place[number]
        start, found = place, [self.costs[0][place]]
        starts = [start]
        for k in range(1, len(self.keys)):
            key = start[: max(0, len(start) - 1)] * self.signs + place[k:]
            key[(start[:-1] == 0) | (place[k:] == 0) | (left[: len(key)] <= k)] = 0
            if self.tables[k - 1] is not None:
                start = self.tables[k - 1][key].astype(np.int64)
            else:
                start = np.searchsorted(self.keys[k], key)
                start[self.keys[k][np.minimum(start, len(self.keys[k]) - 1)] != key] = 0
            told = np.full(len(number), _NEVER, np.int64)
            told[: len(start)] = self.costs[k][start]
            found.append(told)
            starts.append(start)
        return found, starts


def _solve_together(edges: list[np.ndarray], first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each sign the size of the last word of the cheapest path up to it, as in ``best_path``; runs start at ``first`` and have
    ``size`` signs. All runs take a step at once, but for the few longest."""
    back = np.ones(size.sum(), np.int8)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    # a step of all runs takes as long as some 30 signs of one
    apart = int(np.argmin(np.append(0, np.cumsum(size)) + 30 * np.append(size, 0)))
    for at, n in zip(first[:apart].tolist(), size[:apart].tolist(), strict=True):
        costs, best = [e[at : at + n].tolist() for e in edges], [0] * (n + 1)
        own = [1] * n
        for t in range(1, n + 1):
            least, k = best[t - 1] + costs[0][t - 1], 1
            for s in range(2, min(t, len(edges)) + 1):
                cost = best[t - s] + costs[s - 1][t - s]
                if cost <= least:
                    least, k = cost, s
            best[t], own[t - 1] = least, k
        back[at : at + n] = own
    first, size = first[apart:], size[apart:]
    before = [np.zeros(len(first), np.int64)]  # the costs up to the last signs, the latest first
    for t in range(1, int(size.max(initial=0)) + 1):
        n = int(np.searchsorted(-size, -t, "right"))
        at = first[:n] + t - 1
        least, k = before[0][:n] + edges[0][at], np.ones(n, np.int8)
        for s in range(2, min(t, len(edges)) + 1):
            cost = before[s - 1][:n] + edges[s - 1][at - s + 1]
            np.putmask(k, cost <= least, s)
            np.minimum(least, cost, out=least)
        back[at] = k
        before = [least, *before[: len(edges) - 1]]
    return back


def _word_ends(back: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last signs of the words of all paths, in order."""
    ends = np.zeros(len(back), bool)
    at = first + size - 1
    while len(at) > 64:
        ends[at] = True
        at = at - back[at]
        held = at >= first
        at, first = at[held], first[held]
    for last, low in zip(at.tolist(), first.tolist(), strict=True):
        own, place = back[low : last + 1].tolist(), last - low
        while place >= 0:
            ends[low + place] = True
            place -= own[place]
    return np.flatnonzero(ends)


_PLAIN = np.zeros(256, bool)
_PLAIN[ord("0") : ord("9") + 1] = _PLAIN[ord("a") : ord("z") + 1] = True


def _slice_tokens(data: np.ndarray, offsets: np.ndarray, words: _Words, search: bool) -> pa.Array:
    """The tokens of some texts, a list for each."""
    lead, number, begins = _signs(data, offsets)
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(lead)))
    edges, starts = words.edges(number, np.repeat(first + size, size) - np.arange(len(lead)))
    back = _solve_together(edges, first, size)
    last = _word_ends(back, first, size)
    long = back[last]
    start, of = last - long + 1, np.repeat(np.arange(len(last)), long)
    subs = []
    for s in range(2, min(3, len(edges)) + 1) if search else ():
        at = np.flatnonzero(edges[s - 1] < _NEVER)
        at = at[(long[of[at]] > s) & (at + s - 1 <= last[of[at]])]
        subs.append((s, at, np.bincount(of[at], minlength=len(last))))
    # letters and digits
    plain = _PLAIN[data]
    opens, closes = plain.copy(), plain.copy()
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    opens[1:] &= ~plain[:-1]
    closes[:-1] &= ~plain[1:]
    opens[cut] = plain[cut]
    closes[cut - 1] = plain[cut - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # places: a word follows its subwords, everything else stands as in the text
    many = sum((n for _, _, n in subs), np.ones(len(last), np.int64))
    begin = np.concatenate([lead[start], opens])
    order = np.argsort(begin, kind="stable")
    room = np.concatenate([many, np.ones(len(opens), np.int64)])[order]
    upto = np.append(0, np.cumsum(room))
    place = np.empty(len(begin), np.int64)
    place[order] = upto[:-1]
    token = np.empty(upto[-1], np.int64)
    token[place[len(last) :]] = len(words.texts) + np.arange(len(opens))
    place = place[: len(last)]
    for s, at, n in subs:
        token[(place - np.cumsum(n) + n)[of[at]] + np.arange(len(at))] = words.entry[s - 1][starts[s - 1][at]]
        place = place + n
    for s in range(2, len(edges) + 1):
        own = np.flatnonzero(long == s)
        token[place[own]] = words.entry[s - 1][starts[s - 1][start[own]]]
    own = np.flatnonzero(long == 1)
    token[place[own]] = number[start[own]] - 2
    ends = np.append(0, np.cumsum(closes - opens))
    other = pa.Array.from_buffers(pa.large_string(), len(opens), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[plain])])
    strings = pa.concat_arrays([words.texts, other]).take(pa.array(token)).cast(pa.string())
    rows = upto[np.searchsorted(begin[order], offsets)]
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), strings)


def segmented_tokens(texts: DataFrame, costs: DataFrame, id_col: str = "id", text_col: str = "content", longest: int = 4, search: bool = True) -> DataFrame:
    """``id, tokens``: letters and digits as they are in ``retrieval.tokens``, and the words of each run of signs; with
    ``search``, subwords as well. Rows keep their number; a null text has no tokens."""
    costs = stored(costs.select("word", "cost"), "costs")
    size, dear = costs.agg(F.count("*"), F.max("cost")).first()
    if size > HELD_WORDS:
        return _joined_tokens(texts, costs, id_col, text_col, longest, search)
    told = costs.toArrow()
    words = _Words(told.column("word").combine_chunks(), told.column("cost").combine_chunks(), longest, (dear or SCALE) * 2)  # an unknown sign is dearer than any word
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        words.prepare()
        for batch in batches:
            for start, data, offsets in text_slices(batch.column(1), SEGMENT_BYTES):
                tokens = _slice_tokens(data, offsets, words, search)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(tokens)), tokens], ["id", "tokens"])

    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tokens array<string>")


def _joined_tokens(texts: DataFrame, costs: DataFrame, id_col: str, text_col: str, longest: int, search: bool) -> DataFrame:
    """``segmented_tokens`` by a lexicon of any size: distinct runs are dealt into chunks, which are joined with the words they hold."""
    rows = texts.select(F.col(id_col).alias("id"), pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("pieces"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("row", "id", F.posexplode_outer("pieces").alias("at", "piece"))
    signs = F.col("piece").rlike(SIGNS)
    solved = segment_runs(each.where(signs).select(F.col("piece").alias("run")), costs, longest)
    flat = F.flatten(F.zip_with("words", "subwords", lambda w, s: F.concat(s, F.array(w)))) if search else F.col("words")
    joined = each.join(solved.select(F.col("run").alias("piece"), flat.alias("found")), "piece", "left")
    found = F.coalesce("found", F.when(F.col("piece").isNotNull(), F.array("piece")), F.array().cast("array<string>"))
    own = joined.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("at", found.alias("t")))).alias("all"))
    return own.select("id", F.flatten(F.transform("all", lambda x: x["t"])).alias("tokens"))
