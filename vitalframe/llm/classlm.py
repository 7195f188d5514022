"""LM scoring with a Brown class-based bigram model.

Every word of the training texts has one of CLASSES learned classes. The SEEDS most frequent words are put into
classes by exchange clustering of their bigram counts. All other words get the class under which their own
neighbours are most likely: in rounds for the frequent ones (HEAD), whose classes count as neighbours in the next
round, and once more for the rest. Only words that were never seen, which have no counts to learn from, are told by
their endings: they go to the class that holds most of the words of that ending that were seen once. The end of a
text is a class of its own. A token's probability is that of its class after the class before it, times that of the
word in its class. Class transitions are smoothed towards the class frequencies; in a class a word of training count
c has (c + 1) / (all counts + words + endings whose unseen words it takes).

Counts are taken over every training text. Tables of a fixed size (frequent words, classes) travel to the tasks;
the counts and classes of all other words stay in a table and meet the texts' rare words in a join. Texts are read
and hashed twice; the rounds read stored word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, lowered, remainder, sent, stored, text_slices, word_hashes, word_ranges

HEAD = 1 << 18  # most words whose counts and classes travel to the tasks
CLUSTERED = HEAD  # symbols from here on are the endings of words outside the head
SEEDS = 510  # words of the exchange clustering
CLASSES = 48
ENDINGS = 32  # of unseen words, by their last two bytes
ROUNDS = 6  # passes of the exchange over all words
LEARNED = 3  # rounds of all frequent words at most
PULL = 5.0  # weight of the class frequencies in a transition
PRIOR = 10.0  # tokens that the mean neighbours of a word's ending count beside its own


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, bounds) of all words."""
    data = lowered(data)
    start, end, bounds = word_ranges(data, offsets)
    hashes = word_hashes(data, start, end)
    last = data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return hashes, (last * 31 + before * 17) % ENDINGS, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts. Each task adds up its words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            words = np.concatenate([p[0] for p in parts])
            word, at, slot = np.unique(words, return_index=True, return_inverse=True)
            return word, np.concatenate([p[1] for p in parts])[at], np.bincount(slot, np.concatenate([p[2] for p in parts])).astype(np.int64)

        def out(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["word", "ending", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words, endings, _ = hashed_words(data, offsets)
                if len(words):
                    held.append(merged([(words, endings, np.ones(len(words)))]))
                    size += len(held[-1][0])
            if size > 4_000_000:  # what is held stays bounded, whatever the partition
                held = [merged(held)]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(merged(held))

    rows = docs.select("text").mapInArrow(run, "word long, ending int, n long")
    return rows.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Head:
    """Counts of frequent words and their places among the symbols."""

    words: np.ndarray  # sorted uint64
    counts: np.ndarray
    place: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of each word."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words


END = CLUSTERED + ENDINGS
SYMBOLS = END + 1
WIDTH = CLASSES + ENDINGS + 1  # learned classes, one for each ending, one for the end of a text


def _sequence(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All texts' symbols, each text closed by END; a text's first symbol follows the END before it."""
    n = np.diff(bounds)
    out = np.full(len(symbols) + len(n), END, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)] = symbols
    return out


def _symbols(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sequence with ENDs, bounds of the words) of runs of texts stored by ``indexed``."""
    for first, end, data, offsets in text_slices(column):
        codes = data.copy().view(np.int32).astype(np.int64)
        bounds = offsets // 4
        yield first, end, _sequence(np.where(codes >= 0, codes, CLUSTERED - 1 - codes), bounds), bounds


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary rows values[bounds[i]:bounds[i + 1]]."""
    where = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(values))])


def _paired(rows: DataFrame, run, width: int) -> np.ndarray:
    """(width, width) counts from the (pair, n) rows of ``run``."""
    table = rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most width ** 2 rows
    out = np.zeros(width * width, np.int64)
    out[table["pair"].to_numpy(np.int64)] = table["n"]
    return out.reshape(width, width)


def _pairs_of(line: np.ndarray, before: int, width: int) -> np.ndarray:
    return np.bincount(np.concatenate([[before], line[:-1]]) * width + line, minlength=width * width)


def pair_counts(rows: DataFrame, of: np.ndarray, width: int) -> np.ndarray:
    """(width, width) counts of neighbours over all texts, ``of`` telling a symbol's number below ``width``."""
    shared = sent(rows.sparkSession, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared(), np.zeros(width * width, np.int64)
        for batch in batches:
            for _, _, line, _ in _symbols(batch.column(0)):
                total += _pairs_of(own[line].astype(np.int64), int(own[END]), width)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return _paired(rows.select("codes"), run, width)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol. The first ``movable`` symbols move, one at a time, to the class that most raises the
    likelihood of the class bigrams; the others are classes of their own behind the first ``classes``."""
    n = len(pairs)
    pairs = pairs.astype(float)
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    width = classes + n - movable
    member = np.zeros((n, width))
    member[np.arange(n), of] = 1
    grid = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            a = of[w]
            right, left, own = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            if right.sum() + left.sum() == 0:
                continue
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] += own
            right[a] -= own
            left[a] -= own
            row, col = grid.sum(axis=1)[:classes], grid.sum(axis=0)[:classes]
            out, into = grid[:classes], grid[:, :classes].T
            gain = (_f(out + right) - _f(out)).sum(axis=1) + (_f(into + left) - _f(into)).sum(axis=1)
            k = np.arange(classes)
            same = grid[k, k]
            gain += _f(same + right[:classes] + left[:classes] + own) + _f(same) - _f(same + right[:classes]) - _f(same + left[:classes])
            gain -= _f(row + right.sum() + own) - _f(row) + _f(col + left.sum() + own) - _f(col)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += own
            member[w, a], member[w, b], of[w] = 0, 1, b
        if not moved:
            break
    return of


@dataclass
class Model:
    head: Head
    of: np.ndarray  # symbol -> class
    steps: np.ndarray  # (classes, classes) log10 of transitions
    room: np.ndarray  # class -> log10 of the counts it shares out
    tokens: int  # N
    types: int  # V


def _steps(grid: np.ndarray) -> np.ndarray:
    common = (grid.sum(axis=0) + 1) / (grid.sum() + len(grid))
    return np.log10((grid + PULL * common) / (grid.sum(axis=1, keepdims=True) + PULL))


def ending_contexts(rows: DataFrame, of: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """(ENDINGS, 2 * WIDTH) neighbours of a token by ending, as in ``contexts``; ENDINGS marks symbols that do not count."""
    shared, width = sent(rows.sparkSession, (of, ending)), 2 * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, tells), total = shared(), np.zeros((ENDINGS + 1) * width, np.int64)
        for batch in batches:
            for _, _, line, _ in _symbols(batch.column(0)):
                near, row = own[line].astype(np.int64), tells[line].astype(np.int64) * width
                total += np.bincount(row + np.concatenate([[own[END]], near[:-1]]), minlength=len(total))
                total += np.bincount(row[:-1] + WIDTH + near[1:], minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    table = rows.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # of a fixed size
    out = np.zeros((ENDINGS + 1) * width)
    out[table["pair"].to_numpy(np.int64)] = table["n"]
    out = out.reshape(-1, width)[:ENDINGS]
    return out / np.maximum(out[:, :WIDTH].sum(axis=1, keepdims=True), 1)


def contexts(rows: DataFrame, of: np.ndarray, ending: np.ndarray, rare: bool) -> DataFrame:
    """(word, ending, context, n): how often a word stands behind (context < WIDTH) and before (WIDTH + class) each class.

    Words of the head by place, or with ``rare`` all others by hash. Each task adds up what it holds.
    """
    shared = sent(rows.sparkSession, (of, ending))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            key, slot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return key, np.bincount(slot, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(word, symbol, context, n):
            parts = [pa.array(word), pa.array(tells[symbol].astype(np.int32)), pa.array(context.astype(np.int32)), pa.array(n)]
            return pa.RecordBatch.from_arrays(parts, ["word", "ending", "context", "n"])

        def flat(part):
            word = part[0] // (2 * WIDTH)
            return out(word, word, part[0] % (2 * WIDTH), part[1])

        (own, tells), held, size = shared(), [], 0
        for batch in batches:
            for first, end, line, _ in _symbols(batch.column(0)):
                near = own[line].astype(np.int64)
                at = np.flatnonzero((line >= CLUSTERED) & (line < END) if rare else line < CLUSTERED)
                left = np.concatenate([[own[END]], near[:-1]])[at]
                right = WIDTH + near[np.minimum(at + 1, len(near) - 1)]
                if rare:
                    words = batch.column(1).slice(first, end - first).flatten().to_numpy(zero_copy_only=False)
                    yield out(np.tile(words, 2), np.tile(line[at], 2), np.concatenate([left, right]), np.ones(2 * len(at), np.int64))
                elif len(at):
                    keys = line[at] * (2 * WIDTH)
                    held.append(merged([(np.concatenate([keys + left, keys + right]), np.ones(2 * len(at)))]))
                    size += len(held[-1][0])
            if size > 4_000_000:  # what is held stays bounded, whatever the partition
                held = [merged(held)]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield flat(held[0])
                    held, size = [], 0
        if held:
            yield flat(merged(held))

    return rows.select("codes", "rare").mapInArrow(run, "word long, ending int, context int, n long")


def proposed(counts: DataFrame, steps: np.ndarray, room: np.ndarray, mean: np.ndarray) -> DataFrame:
    """(word, class): the learned class under which a word's neighbours are most likely, of rows of ``contexts``.

    The ``mean`` neighbours of its ending count as PRIOR more tokens: one or two neighbours alone tell too little, and
    classes chosen by them make transitions look surer than they are.
    """
    gain = np.concatenate([steps[:, :CLASSES] - room[:CLASSES], steps[:CLASSES].T])
    shared = sent(counts.sparkSession, (gain, PRIOR * np.append(mean, np.zeros((1, len(gain))), axis=0) @ gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, prior = shared()
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                lists = part.column(2)
                entry = lists.flatten()
                n = np.diff(lists.offsets.to_numpy())
                table = np.zeros((part.num_rows, 2 * WIDTH))
                table[np.repeat(np.arange(part.num_rows), n), entry.field(0).to_numpy()] = entry.field(1).to_numpy()
                best = (table @ own + prior[part.column(1).to_numpy()]).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32))], ["word", "class"])

    # one exchange serves both; a word has at most 2 * WIDTH contexts
    summed = counts.repartition("word").groupBy("word", "ending", "context").agg(F.sum("n").alias("n"))
    return summed.groupBy("word").agg(F.first("ending").alias("ending"), F.collect_list(F.struct("context", "n")).alias("seen")).mapInArrow(run, "word long, class int")


def _room(of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts plus words of each class over the head."""
    return np.bincount(of[: len(counts)], counts + 1, minlength=WIDTH).astype(float)


def learned(rows: DataFrame, head: Head, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every symbol, and its ending (seeds and END: none): exchange clustering of the seeds, then rounds in which every word of the head moves.

    Words move at once, so a round may lower the likelihood of the class bigrams; the best round's classes are kept.
    """
    size = len(head.words)
    ranked = np.lexsort((head.words, -head.counts))[:SEEDS]
    seed = np.full(SYMBOLS, SEEDS + ENDINGS, np.int64)
    seed[:size] = SEEDS + endings
    seed[ranked] = np.arange(len(ranked))
    seed[CLUSTERED:END] = SEEDS + np.arange(ENDINGS)
    ending = np.where(seed >= SEEDS, seed - SEEDS, ENDINGS).astype(np.uint8)
    of = exchange(pair_counts(rows, seed, SEEDS + ENDINGS + 1), SEEDS, CLASSES)[seed].astype(np.uint8)
    best, kept = -np.inf, of
    for turn in range(LEARNED + 1):
        grid = pair_counts(rows, of, WIDTH)
        value = _f(grid).sum() - _f(grid.sum(axis=1)).sum() - _f(grid.sum(axis=0)).sum()
        if turn:  # before the first round words still have the classes of their endings
            if value <= best:
                break
            best, kept = value, of
        if turn < LEARNED:
            room = np.log10(np.maximum(_room(of, head.counts), 1))
            mean = ending_contexts(rows, of, ending)
            table = proposed(contexts(rows, of, ending, False), _steps(grid), room, mean).toPandas()  # at most HEAD rows
            of = of.copy()
            of[table["word"].to_numpy(np.int64)] = table["class"]
    return kept, ending


def _indexed(docs: DataFrame, head: Head, texts: int) -> DataFrame:
    """Per document what the fixed tables tell of its words, their numbers (place in the head or -1 - ending), and
    the hashes and positions of words outside the head."""
    shared = sent(docs.sparkSession, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(3)):
                n = end - first
                words, endings, bounds = hashed_words(data, offsets)
                at, found = own.find(words)
                text = np.repeat(np.arange(n), np.diff(bounds))
                known = np.zeros(len(words))
                known[found] = np.log10(own.counts[at[found]] + 1.0)
                rare = np.flatnonzero(~found)
                spans = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(first, n) for k in range(3)),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(np.bincount(text[found], minlength=n) + (1 if texts else 0)),
                        pa.array(np.bincount(text, known, minlength=n) + np.log10(texts + 1.0)),
                        _binary(np.where(found, at, -1 - endings).astype(np.int32), bounds),
                        pa.ListArray.from_arrays(spans, pa.array(words[rare].view(np.int64))),
                        pa.ListArray.from_arrays(spans, pa.array((rare - bounds[text[rare]]).astype(np.int32))),
                    ],
                    ["doc_id", "held_out", "uid", "n_tokens", "n_known", "counted", "codes", "rare", "rare_at"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), F.monotonically_increasing_id().alias("uid"), "text")
    schema = "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, counted double, codes binary, rare array<long>, rare_at array<int>"
    return rows.mapInArrow(run, schema)


def _classed(rows: DataFrame, tail: DataFrame, of: np.ndarray) -> DataFrame:
    """The rows of ``_indexed`` with the classes of their words, rare ones by ``tail`` (word, n, class)."""
    shared = sent(rows.sparkSession, of)
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "rare_at")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.rare_at").alias("at"))
    # unseen words add log10(0 + 1) = 0 and need no row
    found = (
        rare.join(tail, "word")
        .groupBy("uid")
        .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("k"), F.collect_list(F.struct("at", "class")).alias("found"))
    )
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "counted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            for first, end, line, bounds in _symbols(batch.column(0)):
                line = own[line]
                lists = batch.column(1).slice(first, end - first)
                heads = bounds[:-1] + np.arange(end - first)
                n = np.diff(lists.offsets.to_numpy())
                entry = lists.flatten()
                line[np.repeat(heads, n) + entry.field(0).to_numpy()] = entry.field(1).to_numpy()
                ends = np.append(heads, len(line))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, end - first) for k in range(2, 2 + len(columns))), _binary(line, ends)], [*columns, "line"]
                )

    none = F.array().cast("array<struct<at:int,class:int>>")
    joined = rows.join(found, "uid", "left").select(
        "codes",
        F.coalesce("found", none).alias("found"),
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("counted") + F.coalesce("more", F.lit(0.0))).alias("counted"),
    )
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, counted double, line binary")


def _class_pairs(rows: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over the texts of ``_classed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH * WIDTH, np.int64)
        for batch in batches:
            for _, _, line, _ in text_slices(batch.column(0)):
                total += _pairs_of(line.astype(np.int64), WIDTH - 1, WIDTH)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return _paired(rows.select("line"), run, WIDTH)


def fitted(docs: DataFrame, learn: DataFrame, held: bool) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the texts of ``learn``, the stored table (word, ending, n) of all its words, and the stored rows
    of ``_classed`` of ``docs``: those to learn from, with ``held`` without the ones held out."""
    vocabulary = stored(word_counts(learn), "vocabulary")
    texts = learn.count()
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    total, kinds, seen, least = 0, 0, 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        total, kinds, seen = total + row["n"], kinds + row["words"], seen + row["words"]
        if seen <= HEAD:
            least = row["level"]
    least = least if least is not None else 1 << 30
    head = vocabulary.filter(level >= least).toPandas()  # at most HEAD rows
    words, counts, endings = (head[c].to_numpy(np.int64) for c in ("word", "n", "ending"))
    order = np.argsort(words.view(np.uint64))
    words, counts, endings = words.view(np.uint64)[order], counts[order], endings[order]
    table = Head(words, counts, np.arange(len(words)))
    rows = stored(_indexed(docs, table, texts), "indexed")
    mine = rows.filter("not held_out") if held else rows
    of, ending_of = learned(mine, table, endings)
    steps, room = _steps(pair_counts(mine, of, WIDTH)), _room(of, counts)
    classes = proposed(contexts(mine, of, ending_of, True), steps, np.log10(np.maximum(room, 1)), ending_contexts(mine, of, ending_of))
    tail = stored(vocabulary.filter(level < least).join(classes, "word"), "tail")
    # words and words seen once, by ending and class
    kinds_of, once = np.zeros((ENDINGS, CLASSES)), np.zeros((ENDINGS, CLASSES))
    np.add.at(kinds_of, (endings, of[: len(words)]), 1)
    np.add.at(once, (endings, of[: len(words)]), counts == 1)
    for r in tail.groupBy("ending", "class").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).collect():
        kinds_of[r["ending"], r["class"]] += r["words"]
        once[r["ending"], r["class"]] += r["once"]
        room[r["class"]] += r["n"] + r["words"]
    for ending in np.flatnonzero(kinds_of.sum(axis=1)):
        few = once[ending] if once[ending].any() else kinds_of[ending]
        of[CLUSTERED + ending] = few.argmax()
        room[few.argmax()] += 1
    rows = stored(_classed(rows, tail.select("word", "n", "class"), of), "classed")
    grid = _class_pairs(rows.filter("not held_out") if held else rows)
    model = Model(table, of, _steps(grid), np.log10(np.maximum(room, 1)), total + texts, kinds + (texts > 0))
    return model, vocabulary, rows


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the stored table (word, ending, n) of all training words."""
    return fitted(docs, docs, False)[:2]


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of ``_classed`` with the sum of their transitions and rooms."""
    shared = sent(rows.sparkSession, (model.steps, model.room))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "counted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, room = shared()
        for batch in batches:
            for first, end, line, bounds in text_slices(batch.column(len(columns))):
                line = line.astype(np.int64)
                before = np.concatenate([[WIDTH - 1], line[:-1]])
                sums = np.add.reduceat(steps[before, line] - room[line], bounds[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, end - first) for k in range(len(columns))), pa.array(sums)], [*columns, "classed"])

    return rows.select(*columns, "line").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, counted double, classed double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document.

    Learns from documents whose crc32 remainder by 7 is not 2. Null text is empty: one end token. A null id hashes
    as empty text. Repeated rows are scored each. Without training documents every word is unseen and N = V = 0.
    An empty table gives no rows. Other columns are not read.
    """
    learn = docs.filter(remainder(F.col("doc_id"), 7) != 2)
    model, _, rows = fitted(docs, learn, True)
    texts = learn.count()
    base = F.col("counted") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.types + 1)))
    # the end is the only word of its class: its count is no part of the class model
    score = F.col("counted") - F.lit(float(np.log10(texts + 1.0))) + F.col("classed")
    return _scored(rows, model).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op10_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
