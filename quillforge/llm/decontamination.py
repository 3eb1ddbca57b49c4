"""Operator 8: benchmark decontamination by template canonicalisation.

A text becomes a template: lower-cased words, with numbers, names and units of
measure replaced by typed placeholders, a run of one kind by one. Windows of
consecutive template tokens are hashed; documents' windows are hash-joined with the
benchmark's. Where a document has enough of an item's windows, the values in the
placeholders are compared: an item's value must always stand for the same value in
the document and the other way round. So a question with other numbers or names is
caught, and a text that only has a similar form is not. What is a name is told by its
capital, so beside it every item is looked for by windows of its plain words in lower
case: a copy in capitals, title or lower case has these. Items too short for a template window, or
of little but placeholders, are matched exactly, word by word.

Items that differ by nothing but the values in their placeholders (and are alike in which
of them are equal) are one class: their windows are joined once, and a document gives one row for
the class, however many items it has. item_classes() tells the members.

One pass over the documents, however large the benchmark is: a bit map of the
benchmark's window hashes, of bounded size, picks the windows that may meet one.
These alone are shuffled for the join, salted, so that a window of very many
documents is met in several tasks. Nothing of the benchmark but the map is sent to
the executors.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .classifiers import _WORDS, WORD
from .common import id_map, in_map, prepare, row_batches, written

U = np.uint64
NUMBER, NAME, UNIT = 1, 2, 3
#: Values: words that are numbers, and units of measure, lower-cased.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees watt watts volt volts mph kmh hz".split()
#: Words in a window of an item that is matched exactly (all of a shorter one).
EXACT = 8
#: Tasks that the documents' windows of one hash are dealt to.
SALTS = 8
#: Alignments so many tokens apart, at most, can belong to one occurrence of an item.
SHIFT = 8
#: Texts that a task remembers in order to pass over their copies.
KEYS = 1 << 16
_PLACE = K.splitmix(41, 4)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:;\n\""]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with the letters À to Þ in lower case, in UTF-8; A to Z are by the table of hashes."""
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if not len(at):
        return data
    out = data.copy()
    out[at] += np.uint8(0x20)
    return out


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    starts, _, _ = K.spans(data, np.array([0, len(data)]), ~WORD)
    return np.sort(K.word_hashes(data, starts, _WORDS))


_NUMBERS, _UNITS = _hash_of(NUMBER_WORDS), _hash_of(UNITS)


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)


def templates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, kinds (0: a word), values of the placeholders, and the tokens of each text; hashes of the plain words, and the words of each text."""
    starts, ends, counts = K.spans(data, offs, ~WORD)
    n = len(starts)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, U), counts, np.zeros(0, U), counts
    h = K.word_hashes(lowered(data), starts, _WORDS)
    of = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits = sums((data >= 48) & (data <= 57))
    stops = sums(_ENDS[data])
    fresh = first | (stops[starts] - stops[np.concatenate([[0], ends[:-1]])] > 0)
    one, two = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((one >= 65) & (one <= 90)) | ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E) & (two != 0x97))
    kind = np.zeros(n, np.int8)
    kind[capital & ~fresh & (ends - starts > 1)] = NAME
    kind[(digits[ends] > digits[starts]) | _among(h, _NUMBERS)] = NUMBER
    after = np.concatenate([[False], kind[:-1] == NUMBER]) & ~first
    kind[after & (kind == 0) & _among(h, _UNITS)] = UNIT
    keep = (kind == 0) | first | np.concatenate([[True], kind[1:] != kind[:-1]])
    at = np.flatnonzero(keep)
    value = np.add.reduceat(h * (_PLACE[0] | U(1)), at)
    kind = kind[at]
    token = np.where(kind == 0, h[at], _PLACE[kind])
    return token, kind, value, np.bincount(of[at], minlength=len(counts)), h, counts


def _template_windows(token: np.ndarray, kind: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As K.windows, without windows that are placeholders by more than half."""
    h, at, of = K.windows(token, counts, k, seed=50 + k)
    words = np.concatenate([[0], np.cumsum(kind == 0)])
    full = words[at + k] - words[at] >= (k + 1) // 2
    return h[full], at[full], of[full]


def _exact_windows(h: np.ndarray, counts: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of plain words; those of fewer than `least` words are whole texts only."""
    got = K.windows(h, counts, size, seed=90 + size)
    if size >= least:
        return got
    whole = counts[got[2]] == size
    return tuple(x[whole] for x in got)


_ITEM_WINDOWS = "h long, cls long, item long, item_id long, first int, place int, n_windows int, size int, kinds binary, slots binary"


def _class_of(token: np.ndarray, kind: np.ndarray, value: np.ndarray) -> int:
    """The same for items with the same template whose placeholders are equal to one another in the same places."""
    slots = value[kind > 0]
    _, at, which = np.unique(slots, return_index=True, return_inverse=True)
    return xxhash.xxh64_intdigest(token.tobytes() + at[which].astype(np.int64).tobytes()) - (1 << 63)


def item_windows(benchmark: DataFrame, k: int, least: int) -> DataFrame:
    """A row for each window of each item (first: 1 for one row of each): its hash, its place in the item, how many of the kind the item has.

    size 0 are template windows, with the kinds and values of their k tokens (empty if all are words);
    size -k windows of plain words of the same items; size > 0 windows of an item that is matched exactly.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, _, data, offs in K.blocks(batch.column(2)):
                token, kind, value, counts, word, words = templates(data, offs)
                end, word_end = np.cumsum(counts), np.cumsum(words)
                for j, (n, m) in enumerate(zip(counts.tolist(), words.tolist(), strict=True)):
                    item, item_id = batch.column(0)[i + j].as_py(), batch.column(1)[i + j].as_py()
                    tokens, kinds, values, own = token[end[j] - n : end[j]], kind[end[j] - n : end[j]], value[end[j] - n : end[j]], word[word_end[j] - m : word_end[j]]
                    h, at, _ = _template_windows(tokens, kinds, np.array([n]), k)
                    cls = _class_of(tokens, kinds, values) if len(h) else _class_of(own, np.zeros(m, np.int8), own)
                    out = []
                    for x, p in zip(h.view(np.int64).tolist(), at.tolist(), strict=True):
                        slots = kinds[p : p + k].any()
                        out.append((x, p, len(h), 0, kinds[p : p + k].tobytes() if slots else b"", values[p : p + k].tobytes() if slots else b""))
                    if m:
                        size = k if len(h) else min(m, EXACT)
                        g, at, _ = _exact_windows(own, np.array([m]), size, least)
                        out += [(x, p, len(g), -size if len(h) else size, b"", b"") for x, p in zip(g.view(np.int64).tolist(), at.tolist(), strict=True)]
                    rows += [(x, cls, item, item_id, int(not r), *rest) for r, (x, *rest) in enumerate(out)]
            yield from row_batches(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()], ["h", "cls", "item", "item_id", "first", "place", "n_windows", "size", "kinds", "slots"])

    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(run, _ITEM_WINDOWS)


def item_classes(benchmark: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """(item_id, class_id) for each item of benchmark(item_id, text) that has words: class_id is the least item_id of those with its template."""
    items = item_windows(benchmark, k, least).where("first = 1").select("item_id", "cls")
    return items.join(items.groupBy("cls").agg(F.min("item_id").alias("class_id")), "cls").select("item_id", "class_id")


def _class_windows(items: DataFrame) -> DataFrame:
    """The windows of each class, once: the template windows of its first item, the different word windows of all."""
    least = items.groupBy("cls").agg(F.min("item").alias("item"), F.min("item_id").alias("item_id"), F.sum("first").cast("long").alias("n_items"))
    columns = ["h", "item", "item_id", "n_items", "place", "n_windows", "size", "kinds", "slots"]
    template = items.where("size = 0").drop("item_id").join(least, ["cls", "item"]).select(*columns)
    words = items.where("size <> 0").groupBy("cls", "h", "place", "size").agg(F.min("n_windows").alias("n_windows"), F.min("kinds").alias("kinds"), F.min("slots").alias("slots"))
    return template.unionByName(words.join(least, "cls").select(*columns))


def _consistent(pairs: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """Of the slots compared: how many, how many fit one mapping of values both ways, how many have another value."""
    there, back = defaultdict(Counter), defaultdict(Counter)
    for a, b in pairs.values():
        there[a][b] += 1
        back[b][a] += 1
    fit = sum(there[a].most_common(1)[0][0] == b and back[b].most_common(1)[0][0] == a for a, b in pairs.values())
    return len(pairs), fit, sum(a != b for a, b in pairs.values())


def _agreeing(along: dict[int, dict[int, list]], enough: float, agree: float) -> tuple[int, int] | None:
    """Slots compared and slots changed of the best alignment of an item with a text whose slots agree, if any.

    along: for each shift between item and text, by place in the item, the slots
    (place, item's value, text's value) of the window there. Every alignment with
    enough windows is tested (if there is none, the commonest), those with most
    windows first, then those with fewest changes. If none agrees, windows of
    alignments up to SHIFT tokens apart are taken together, so that an occurrence
    with a few words more or less is tested as one.
    """

    def compared(windows):
        pairs = {place: (a, b) for slots in windows for place, a, b in slots}
        slots, fit, changed = _consistent(pairs)
        return (slots, changed) if fit >= agree * slots else None

    whole = [own for own in along.values() if len(own) >= enough] or [max(along.values(), key=len)]
    told = [(-len(own), t[1], t[0]) for own in whole if (t := compared(own.values()))]
    if told:
        _, changed, slots = min(told)
        return slots, changed
    for shift in sorted(along):
        near = [s for x in range(SHIFT, 0, -1) for s in (shift + x, shift - x) if s in along]
        own = [s for s in [*near, shift] if s in along]  # the nearest last: its values count
        if near and len({p for s in own for p in along[s]}) >= enough and (t := compared([w for s in own for w in along[s].values()])):
            return t
    return None


def _new(seen: set, k1: list, k2: list) -> list[bool]:
    """Which keys a task meets for the first time, as far as it remembers (KEYS of them)."""
    out = []
    for key in zip(k1, k2, strict=True):
        out.append(key not in seen)
        if len(seen) >= KEYS:
            seen.clear()
        seen.add(key)
    return out


def _close(along: dict[int, dict], enough: float) -> int:
    """How many places of an item have a window in alignments up to SHIFT tokens apart, if these are enough, else 0."""
    most = max(len({p for x in range(shift - SHIFT, shift + SHIFT + 1) if x in along for p in along[x]}) for shift in along)
    return most if most >= enough else 0


def _judged(rows: DataFrame, k: int, coverage: float, agree: float, fewest: int) -> DataFrame:
    """The items that texts contain. rows: windows that a text (k1, k2) and a class of items both have, those of one text and class one after the other."""

    def judge(held: list) -> tuple | None:
        k1, k2, _, item_id, n_items = held[0][:5]
        along, whole = defaultdict(lambda: defaultdict(dict)), {}
        for *_, n_windows, size, place, at, kinds, mine, its in held:
            slots = ()
            if any(kinds):
                a, b = np.frombuffer(mine, np.int64), np.frombuffer(its, np.int64)
                slots = [(place + t, int(a[t]), int(b[t])) for t in range(k) if kinds[t]]
            kind = (size > 0) - (size < 0)
            along[kind][at - place][place] = slots
            whole[kind] = min(n_windows, whole.get(kind, n_windows))
        least = {kind: max(coverage * n, min(n, fewest)) for kind, n in whole.items()}
        n = {kind: len({p for places in own.values() for p in places}) for kind, own in along.items()}
        full = {kind: any(len(places) >= whole[kind] for places in own.values()) for kind, own in along.items()}
        if 1 in along:
            return (k1, k2, item_id, n_items, n[1], whole[1], 0, 0) if full[1] else None
        if 0 in along and n[0] >= least[0] and (told := _agreeing(along[0], least[0], agree)):
            slots, changed = told
            return k1, k2, item_id, n_items, n[0], whole[0], slots, 0 if full.get(-1) else changed
        if -1 in along and (close := _close(along[-1], least[-1])):
            return k1, k2, item_id, n_items, close, whole[-1], 0, 0
        return None

    def run(batches):
        names = ["k1", "k2", "item_id", "n_items", "n_windows", "item_windows", "n_slots", "n_changed"]
        told = []
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True))
        for _, held in groupby(each, key=lambda row: row[:3]):
            if found := judge(list(held)):
                told.append(found)
            if len(told) == 1024:
                yield from row_batches(told, [pa.int64()] * 8, names)
                told = []
        yield from row_batches(told, [pa.int64()] * 8, names)

    needed = rows.select("k1", "k2", "item", "item_id", "n_items", "n_windows", "size", "place", "at", "kinds", "slots", "values")
    return needed.mapInArrow(run, "k1 long, k2 long, item_id long, n_items long, n_windows long, item_windows long, n_slots long, n_changed long")


def _found(texts: DataFrame, benchmark: DataFrame, k: int, coverage: float, agree: float, least: int, fewest: int, map_bits: int, copies: bool = False) -> DataFrame:
    """(k1, k2, item_id, n_items, n_windows, item_windows, n_slots, n_changed) for texts with the keys k1 and k2 and a text. copies: rows of one key have one text, which is judged once."""
    spark = texts.sparkSession
    items = written(_class_windows(written(item_windows(benchmark, k, least), "items")), "item_classes")
    sizes = sorted(r["size"] for r in items.where("size <> 0").select(F.abs("size").alias("size")).distinct().collect())  # EXACT at most
    sent = spark.sparkContext.broadcast(id_map(items.select("h"), map_bits, each=2048))

    def run(batches):
        hits, seen = sent.value, set()
        for batch in batches:
            if copies:
                batch = batch.filter(pa.array(_new(seen, batch.column(0).to_pylist(), batch.column(1).to_pylist()), pa.bool_()))
            k1, k2 = batch.column(0), batch.column(1)
            for i, _, data, offs in K.blocks(batch.column(2)):
                token, kind, value, counts, word, words = templates(data, offs)
                of_template = _template_windows(token, kind, counts, k)
                for size in (0, *sizes):
                    h, at, of = of_template if not size else _exact_windows(word, words, size, least)
                    hit = in_map(hits, h.view(np.int64))
                    if not hit.any():
                        continue
                    h, at, of = h[hit], at[hit], of[hit]
                    begin = np.cumsum(words if size else counts) - (words if size else counts)
                    row = pa.array(of + i)
                    values = value[at[:, None] + np.arange(k)].tobytes() if not size else None
                    values = pa.nulls(len(at), pa.binary()) if size else pa.Array.from_buffers(pa.binary(8 * k), len(at), [None, pa.py_buffer(values)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([k1.take(row), k2.take(row), pa.array(h.view(np.int64)), pa.array((at - begin[of]).astype(np.int32)), values], ["k1", "k2", "h", "at", "values"])

    met = texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, h long, at int, values binary")
    if copies:
        met = met.distinct()  # each task has sent a text's windows once; here they meet by window
    met = met.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = met.join(salted.hint("merge"), ["h", "salt"])  # a benchmark of any size; its windows are no driver's
    return _judged(joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "item"), k, coverage, agree, fewest)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.33, agree: float = 0.8, least: int = 3, fewest: int = 4, map_bits: int = 28) -> DataFrame:
    """(doc_id, item_id, n_items, n_windows, item_windows, n_slots, n_changed): items that documents contain.

    docs has doc_id and text, benchmark item_id and text. Items of one template are a
    class: item_id is its least and n_items their number (item_classes() has the members). An item counts as
    contained if at least `coverage` of its windows of k template tokens, and `fewest`
    of them or all, come in the document and at least `agree` of the compared placeholders fit one
    mapping of values at one of the places where it may stand (_agreeing());
    n_changed tells how many have another value there than in the class's first item (0: a
    verbatim leak, of any item of the class). It counts as well, in any letter case, if as many of its windows of k plain words come,
    in alignments up to SHIFT words apart. Windows that are placeholders by more than half don't count. An
    item without any window that does counts as contained where all its words, in
    lower case, come one after the other; one of fewer than `least` words only in a
    document that has no others. Items without words are never matched. Null or
    empty texts match nothing; repeated documents give a row each, repeated items are one class; null
    ids stay null; extra columns are left out; an empty table on either side gives
    no rows. map_bits bounds the bit map of the benchmark: a full map costs time only.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("k1"), F.col("doc_id").cast("long").alias("k2"), F.col("text").alias("text"))
    return _found(texts, benchmark, k, coverage, agree, least, fewest, map_bits).drop("k1").withColumnRenamed("k2", "doc_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.33, agree: float = 0.8, least: int = 3, fewest: int = 4, map_bits: int = 28) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item by the rule of leaks().

    Texts found are known by two 64-bit hashes; copies of a text are judged once, so
    that a group of copies of any size is one text's work. A bit map of these, of bounded size,
    parts the rows: those not in it are kept as they are read, only the others are
    compared with the texts found. Repeated rows are kept or go alike; null and
    empty texts stay; an empty benchmark keeps all.
    """
    prepare(docs.sparkSession)
    one, two = "_text_hash_1", "_text_hash_2"
    keyed = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")})
    found = _found(keyed.select(F.col(one).alias("k1"), F.col(two).alias("k2"), "text"), benchmark, k, coverage, agree, least, fewest, map_bits, copies=True)
    found = written(found.select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct(), "found")
    sent = docs.sparkSession.sparkContext.broadcast(id_map(found.select(one), map_bits))
    at = keyed.columns.index(one)

    def part(keep: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_map(sent.value, batch.column(at).to_numpy(zero_copy_only=False)) != keep))

        return keyed.mapInArrow(run, keyed.schema)

    return part(True).unionByName(part(False).join(found, [one, two], "left_anti").select(*keyed.columns)).drop(one, two)
