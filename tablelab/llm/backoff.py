"""Language-model scores of documents: stupid backoff over n-gram count tables.

A word scores c(n-gram) / c(n-gram without its last word) by the longest n-gram of up to ``order`` words that ends in
it and that the corpus has ``least`` times; each order that fails costs a factor ALPHA, and a single word scores
c(word) / N. With ``leave_out`` the word's own place counts nowhere (all counts and N are less by one), so that no text
is scored by itself, and a word without another place scores 1 / N. No n-gram is left out of the counts. A document's
score is the sum of the logarithms, and its mean.

The defaults (order 2, pairs from twice on, own places counted) are those of ``op7_backoff`` and its SQL twin;
``op7_backoff_orders`` takes orders up to 5 from one other occurrence on.

Words with their histories are dealt out by the hash of the word, so a part holds the counts of all n-grams that end
in its words, and joins its own n-grams to them, order by order. Counts of contexts stand in other parts: hits are
joined to them in a second step. Sums by document meet in the end, in blocks of documents.

Hot n-grams (a share of 1/``HEAVY`` or more of the words, so at most ``2 * HEAVY`` of each order) are counted beforehand
and sent to all tasks. A word is dealt out by the shortest n-gram before it that is not hot; if all are, it is
scored where it is read.

Defined cases: null and wordless texts have no words, the sum 0 and a null mean; rows of one id count as one
document; rows of a null id count for the corpus and get a score together; the key is an integer; an empty table
gives an empty result; columns beyond the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .arrow import give_back, small_batches, stored

ALPHA = 0.4
LEAST = 2
#: Longest n-grams of ``op7_backoff_orders``.
ORDER = 5
HEAVY = 2000
#: Bytes of a part's n-grams. Its counts and open contexts have three times as much, which a task holds beside them.
PART_BYTES = 8 << 20
#: Words of a part that are counted at once, about; sorting them takes about 150 bytes for each.
SHARE_WORDS = 150_000
#: Of a word of an entry, as it travels.
ENTRY_BYTES = 3
#: Bytes of text whose entries are dealt out at once; the more, the fewer words stand twice in a part's rows.
DEALT_BYTES = 2 << 20
#: Frequent words that travel as short codes instead of hashes, at most; they come from the first slice of each task.
CODED = 30_000
#: Bytes of text whose words are hashed at once.
HASH_BYTES = 1 << 18
#: Words of the documents whose sums are added up together, about.
BLOCK_WORDS = 2_000_000
#: Entries of a row that a part makes, at most, so that rows stay small where they are written and read.
ROW_ENTRIES = 1 << 15
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(1 << 63)


def _ngrams(column: pa.Array, order: int):
    """Words of a column and their histories: sorted distinct hashes after a 0, codes into them, word offsets of rows.

    ``codes[k]`` has the word k places before each word, 0 before a text's start.
    """
    pieces = [words.word_hashes(*words.utf8(column.slice(i, j - i))) for i, j in words.steps(column, HASH_BYTES)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in pieces)])
    offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(p[3]) for p in pieces)]))
    del pieces
    found, inverse = np.unique(np.maximum(hashes, np.uint64(1)), return_inverse=True)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    codes = np.zeros((order, len(hashes)), np.int32)
    for k in range(min(order, len(hashes))):
        codes[k, k:] = inverse[: len(hashes) - k] + 1
        codes[k, place < k] = 0
    return np.concatenate([np.zeros(1, np.uint64), found]), codes, offsets


def _longer(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of n-grams with one word more in front; a word is its own key."""
    return words.mix(key * _GOLDEN + words.mix(before))


def _slices(batches: Iterator[pa.RecordBatch], limit: int = words.STEP_BYTES):
    for batch in batches:
        column = batch.column("text")
        for start, end in words.steps(column, limit):
            yield batch.column("id").slice(start, end - start), column.slice(start, end - start)


def _heavy_counts(docs: DataFrame, order: int) -> tuple[int, dict[str, np.ndarray]]:
    """Number of words, and the keys of the hot n-grams of all orders with their exact counts.

    ``words`` are those that travel as codes, the most frequent first: hot ones, and others that are frequent in a sample.
    """

    def rows(kinds, keys, counts):
        columns = [pa.array(np.concatenate(x)) for x in (kinds, keys, counts)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "ngram", "n"])

    def candidates(batches):
        for number, (_, column) in enumerate(_slices(batches)):
            table, codes, _ = _ngrams(column, order)
            n = codes.shape[1]
            kinds, found, counts = [np.array([-1], np.int32)], [np.zeros(1, np.int64)], [np.array([n], np.int64)]
            at, key = np.arange(n), table[codes[0]]
            for k in range(order):
                if k:  # what is hot has a hot end
                    at, key = at[codes[k, at] > 0], key[codes[k, at] > 0]
                    key = _longer(key, table[codes[k, at]])
                value, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                if not k and not number:
                    kinds.append(np.full(int((count > 1).sum()), -2, np.int32))
                    found.append(value[count > 1].view(np.int64))
                    counts.append(count[count > 1].astype(np.int64))
                often = count * 2 * HEAVY >= n
                kinds.append(np.full(int(often.sum()), k, np.int32))
                found.append(value[often].view(np.int64))
                counts.append(count[often].astype(np.int64))
                at, key = at[often[inverse]], key[often[inverse]]
            yield rows(kinds, found, counts)
        give_back()

    sums = stored(docs.mapInArrow(candidates, "kind int, ngram long, n long").groupBy("kind", "ngram").agg(F.sum("n").alias("n")), "candidates")
    total = sums.filter("kind = -1").head()
    total = total["n"] if total else 0
    # What is hot overall is found in each slice where it is half as hot, so its sum is at least half its count.
    often = sums.filter((F.col("kind") >= 0) & (F.col("n") * 2 * HEAVY >= total)).collect()  # at most 2 * HEAVY of each kind
    array = lambda rows: np.array([r["ngram"] for r in rows], np.int64).view(np.uint64)
    coded = sums.filter("kind = -2").orderBy(F.desc("n"), "ngram").limit(CODED).collect()
    hot, coded = np.sort(array(often)), array(coded)
    codes = np.concatenate([coded, np.setdiff1d(array([r for r in often if r["kind"] == 0]), coded)])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def exact(batches):
        for _, column in _slices(batches):
            table, codes, _ = _ngrams(column, order)
            at, key = np.arange(codes.shape[1]), table[codes[0]]
            count = np.zeros(len(shared.value), np.int64)
            for k in range(order):
                if k:
                    at, key = at[codes[k, at] > 0], key[codes[k, at] > 0]
                    key = _longer(key, table[codes[k, at]])
                place, known = _find(shared.value, key)
                count += np.bincount(place[known], minlength=len(count))
                at, key = at[known], key[known]
            seen = np.flatnonzero(count)
            yield rows([np.zeros(len(seen), np.int32)], [shared.value[seen].view(np.int64)], [count[seen]])
        give_back()

    found = docs.mapInArrow(exact, "kind int, ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(hot))
    if found:
        keys, n = np.array([r["ngram"] for r in found], np.int64).view(np.uint64), [r["n"] for r in found]
        counts[np.searchsorted(hot, keys)] = n
    return total, {"words": codes, "keys": hot, "counts": counts}


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (words.mix(key) % np.uint64(parts)).astype(np.int64)


_SCHEMA = "kind int, part int, ids binary, a binary, b binary"
_NAMES = ["kind", "part", "ids", "a", "b"]


def _bytes(values: np.ndarray) -> bytes:
    """Bytes of a column. Ids and numbers are steps (where they rise) or offsets from the least, as short as they can be.

    The length before compression stands in front, 0 if there is none.
    """
    raw = values.tobytes()
    if values.dtype.kind == "i" or values.dtype == np.uint32:
        values = values.astype(np.int64)
        rising = bool((values[1:] >= values[:-1]).all())
        low = values[:1] if rising else values.min(keepdims=True)
        rest = values.view(np.uint64) - (low.view(np.uint64) if len(low) else np.uint64(0))  # modulo 2 ** 64, as the range may be
        if rising:
            rest[1:] -= rest[:-1].copy()
        width = next(w for w in (1, 2, 4, 8) if int(rest.max(initial=0)) < 1 << 8 * w)
        raw = bytes([width + 16 * rising]) + low.tobytes() + rest.astype(f"<u{width}").tobytes() if len(values) else b""
    short = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
    return len(raw).to_bytes(4, "little") + short if len(short) < len(raw) else bytes(4) + raw


def _raw(packed: pa.Scalar) -> pa.Buffer:
    packed = packed.as_buffer()
    size = int(np.frombuffer(packed, "<u4", 1)[0])
    return pa.decompress(packed.slice(4), size, codec="zstd") if size else packed.slice(4)


def _numbers(packed: pa.Scalar) -> np.ndarray:
    """Ids and numbers of a row, from ``_bytes``."""
    raw = _raw(packed)
    if not raw.size:
        return np.zeros(0, np.int64)
    head = int(np.frombuffer(raw, np.uint8, 1)[0])
    rest = np.frombuffer(raw, f"<u{head % 16}", -1, 9).astype(np.uint64)
    if head > 16:
        rest = np.cumsum(rest, dtype=np.uint64)
    return (rest + np.frombuffer(raw, np.uint64, 1, 1)).view(np.int64)


def _keys(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(_raw(packed), np.uint64)


def _cut(kind: int, part: int, *columns: np.ndarray):
    """Rows of at most ``ROW_ENTRIES`` entries."""
    for i in range(0, len(columns[0]), ROW_ENTRIES):
        yield kind, part, *(c[i : i + ROW_ENTRIES] for c in columns)


def _rows(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*[(k, p, *(_bytes(x) for x in rest)) for k, p, *rest in rows], strict=True)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def _sums(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids with the sum and number of their values."""
    found, inverse = np.unique(ids, return_inverse=True)
    return found, np.bincount(inverse, values, len(found)), np.bincount(inverse, minlength=len(found)).astype(np.int32)


def _hot_depth(hot, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For word histories (the last word first, 0 for none): how many of the n-grams at their end are hot, the counts of
    these by order, the key of the shortest one that is not hot, and the number of orders that there are."""
    n = len(history[0])
    depth, orders, counts, cold = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((len(history), n)), np.zeros(n, np.uint64)
    at, key = np.arange(n), history[0]
    for k, word in enumerate(history):
        orders += word > 0
        key, at = key[word[at] > 0], at[word[at] > 0]
        if k:
            key = _longer(key, word[at])
        place, known = _find(hot["keys"], key)
        cold[at[~known]] = key[~known]
        at, key = at[known], key[known]
        counts[k, at] = hot["counts"][place[known]]
        depth[at] += 1
    return depth, counts, cold, orders


def _packed(table: np.ndarray, word_code: np.ndarray, n_coded: int, codes: np.ndarray) -> np.ndarray:
    """Bytes of word histories: the number of words without a code of all tasks, their hashes, and a code for each place."""
    used, inverse = np.unique(codes, return_inverse=True)
    code, own = word_code[used], (used > 0) & (word_code[used] == 0)
    code[own] = n_coded + 1 + np.arange(int(own.sum()))
    places = code[inverse.ravel()].astype("<u2" if n_coded + own.sum() < 65535 else "<u4")
    # High bytes stand together, as most of them are small.
    places = places.view(np.uint8).reshape(-1, places.itemsize).T.ravel()
    return np.concatenate([np.array([own.sum()], "<u4").view(np.uint8), table[used[own]].view(np.uint8), places])


def _histories(raw: pa.Buffer, coded: np.ndarray, order: int) -> np.ndarray:
    own = int(np.frombuffer(raw, "<u4", 1)[0])
    table = np.concatenate([np.zeros(1, np.uint64), coded, np.frombuffer(raw, np.uint64, own, 4)])
    width = 2 if len(coded) + own < 65535 else 4
    codes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 4 + 8 * own).reshape(width, -1).T).view(f"<u{width}")
    return table[codes].reshape(order, -1)


class _Rule:
    """Scores of words by the counts of the n-grams that end in them."""

    def __init__(self, total: int, alpha: float, least: int, leave_out: bool):
        self.own, self.least, self.alpha = int(leave_out), least, math.log(alpha)
        self.total = math.log(max(total - self.own, 1))

    def hits(self, counts: np.ndarray) -> np.ndarray:
        return counts - self.own >= self.least

    def score(self, counts: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest order that scores, and the logarithms without what the contexts of orders over 1 take off."""
        longest = 1 + np.cumprod(self.hits(counts[1:]), axis=0).sum(axis=0, dtype=np.int64)
        found = np.maximum(counts[longest - 1, np.arange(len(orders))] - self.own, 1)
        return longest, np.log(found) + self.alpha * (orders - longest) - np.where(longest == 1, self.total, 0.0)


def _explode(docs: DataFrame, heavy, parts: int, order: int, rule: _Rule) -> DataFrame:
    """Rows of kind 0 (sums of words all whose n-grams are hot) and 3 (a part's n-grams of many documents).

    Of kind 3: ids, a number of entries for each id (in ``a``), and the entries (in ``b``), words with their histories.
    """

    def run(batches):
        hot = heavy.value
        sorting = np.argsort(hot["words"])
        coded = hot["words"][sorting]
        for ids, column in _slices(batches, DEALT_BYTES):
            table, codes, offsets = _ngrams(column, order)
            ids = ids.fill_null(_NULL_ID).to_numpy()
            doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
            depth, counts, cold, orders = _hot_depth(hot, [table[c] for c in codes])
            known = depth == orders
            rows = []
            if known.any():
                longest, value = rule.score(counts[:, known], orders[known])
                long = np.flatnonzero(longest > 1)
                own = np.flatnonzero(known)[long]
                # The context of a hot n-gram is hot too.
                _, context, _, _ = _hot_depth(hot, [table[c] for c in codes[1:, own]]) if len(own) else (0, np.ones((1, 0)), 0, 0)
                value[long] -= np.log(context[longest[long] - 2, np.arange(len(own))] - rule.own)
                rows.append((0, -1, *_sums(ids[doc[known]], value)))
            at, found = _find(coded, table)
            word_code = np.zeros(len(table), np.int64)
            word_code[found] = sorting[at[found]] + 1
            part = _part(cold, parts)
            rest = np.flatnonzero(~known)
            rest = rest[np.argsort(part[rest], kind="stable")]
            cuts = np.searchsorted(part[rest], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                own = rest[cuts[p] : cuts[p + 1]]
                present, numbers = np.unique(doc[own], return_counts=True)
                rows.append((3, int(p), ids[present], numbers.astype("<u4"), _packed(table, word_code, len(hot["words"]), codes[:, own])))
            yield from _rows(rows).to_batches()
        give_back()

    return docs.mapInArrow(run, _SCHEMA)


def _sum_rows(ids: np.ndarray, sums: np.ndarray, places: np.ndarray, blocks: int):
    """Sums (kind 0) by blocks of documents, which stand in place of the part."""
    block = _part(ids.view(np.uint64), blocks)
    sorting = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[sorting], np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = sorting[cuts[b] : cuts[b + 1]]
        yield from _cut(0, int(b), ids[own], sums[own], places[own].astype(np.int32))


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of several sums, with the sum of their values and of their numbers."""
    ids, values, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
    found, inverse = np.unique(ids, return_inverse=True)
    return found, np.bincount(inverse, values, len(found)), np.bincount(inverse, numbers, len(found)).astype(np.int64)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and numbers by id of rows of kind 0, of which only some are held at once."""
    held, size, most = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0, 8 * ROW_ENTRIES
    for batch in batches:
        for ids, values, numbers in zip(batch.column("ids"), batch.column("a"), batch.column("b"), strict=True):
            held.append((_numbers(ids), np.frombuffer(_raw(values), np.float64), _numbers(numbers)))
            size += len(held[-1][0])
            if size > max(most, 2 * len(held[0][0])):
                held, size = [_added(held)], 0
    return _added(held)


def _scorer(heavy, parts: int, order: int, rule: _Rule, blocks: int = 1):
    """Function from all n-grams of a part to sums (kind 0), open contexts (kind 1) and n-gram counts (kind 2)."""

    def counted(ids: np.ndarray, history: list[np.ndarray], depth: np.ndarray, counts: np.ndarray, orders: np.ndarray):
        """Words' ids and logarithms, n-grams that can be contexts with their counts, and (part, id, context) of open ones.

        No other words have an n-gram of these that is not hot.
        """
        often_keys, often_counts = [], []
        at, key = np.arange(len(ids)), history[0]
        for k in range(order):
            if k:  # an n-gram is no more frequent than its end
                more = (history[k][at] > 0) & rule.hits(counts[k - 1, at])
                at, key = at[more], key[more]
                key = _longer(key, history[k][at])
            fresh = depth[at] <= k
            value, inverse, number = np.unique(key[fresh], return_inverse=True, return_counts=True)
            counts[k, at[fresh]] = number[inverse]
            often = rule.hits(number)
            if k < order - 1 and often.any():  # contexts of n-grams that score are as frequent
                often_keys.append(value[often])
                often_counts.append(number[often].astype(np.int64))
        longest, value = rule.score(counts, orders)
        del counts, at, key
        long = np.flatnonzero(longest > 1)
        behind = [np.where(longest[long] > k, history[k][long], np.uint64(0)) for k in range(1, order)]
        opened = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(long):
            depth, context, cold, orders = _hot_depth(heavy.value, behind)
            known = depth == orders
            value[long[known]] -= np.log(context[longest[long[known]] - 2, np.flatnonzero(known)] - rule.own)
            key = behind[0]
            for k in range(1, order - 1):
                key = np.where(behind[k] > 0, _longer(key, behind[k]), key)
            open_ = np.flatnonzero(~known)
            opened = _part(cold[open_], parts), ids[long[open_]], key[open_]
        return (ids, value), (often_keys, often_counts), opened

    def score(table: pa.Table) -> pa.Table:
        hot = heavy.value
        part = table.column("part")[0].as_py()
        numbers = [_numbers(x) for x in table.column("a")]
        cuts = np.cumsum([0, *(int(x.sum()) for x in numbers)])
        ids, history = np.empty(cuts[-1], np.int64), np.empty((order, cuts[-1]), np.uint64)
        for i, j, number, of, raw in zip(cuts, cuts[1:], numbers, table.column("ids"), table.column("b"), strict=False):
            ids[i:j] = np.repeat(_numbers(of), number)
            history[:, i:j] = _histories(_raw(raw), hot["words"], order)
        del numbers
        # Words of one cold n-gram stand in one share, so the shares are counted one after another.
        shares = max(1, math.ceil(len(ids) / SHARE_WORDS))
        share = np.empty(len(ids), np.int32)
        for i in range(0, len(ids), SHARE_WORDS):
            cold = _hot_depth(hot, [h[i : i + SHARE_WORDS] for h in history])[2]
            share[i : i + SHARE_WORDS] = words.mix(cold) // np.uint64(parts) % np.uint64(shares)
        rows, sums, opened = [], [], []
        for s in range(shares):
            own = np.flatnonzero(share == s)
            some = [h[own] for h in history]
            depth, counts, _, orders = _hot_depth(hot, some)
            (found, value), often, more = counted(ids[own], some, depth, counts, orders)
            sums.append(_sums(found, value))
            for keys, n in zip(*often, strict=True):
                rows += _cut(2, part, keys, n, keys[:0])
            opened.append(more)
        to, of, keys = (np.concatenate(x) for x in zip(*opened, strict=True))
        sorting = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[sorting], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            own = sorting[cuts[p] : cuts[p + 1]]
            rows += _cut(1, int(p), of[own], keys[own], keys[:0])
        rows += _sum_rows(*_added(sums), blocks)
        return _rows(rows)

    return score


def _closer(own: int, blocks: int):
    """Function to the sums of what the contexts of hits take off, of one part."""

    def contexts(opened: pa.Table, counted: pa.Table) -> pa.Table:
        if not opened.num_rows:
            return _rows([])
        join = lambda column, read: np.concatenate([read(x) for x in column] or [np.zeros(0, np.uint64)])
        keys, counts = join(counted.column("ids"), _keys), join(counted.column("a"), _numbers)
        order = np.argsort(keys)
        at, _ = _find(keys[order], join(opened.column("a"), _keys))
        ids, sums, _ = _sums(join(opened.column("ids"), _numbers), -np.log(counts[order][at] - own))
        made = _rows(list(_sum_rows(ids, sums, np.zeros(len(ids), np.int32), blocks)))
        give_back()
        return made

    return contexts


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a block."""
    ids, sums, numbers = _sum_up(batches)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, numbers, sums)], ["id", "n_words", "log_score"])
    give_back()


def scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, least: int = LEAST, part_bytes: int = PART_BYTES,
    order: int = 2, leave_out: bool = False,
) -> DataFrame:
    """(id, n_words, log_score): words and the sum of the logarithms of their scores, of ids with words."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")
    total, heavy = _heavy_counts(small_batches(rows), order)
    parts, blocks = max(1, math.ceil(total * ENTRY_BYTES * order / part_bytes)), max(1, math.ceil(total / BLOCK_WORDS))
    shared = rows.sparkSession.sparkContext.broadcast(heavy)
    rule = _Rule(total, alpha, least, leave_out)
    exploded = _explode(rows, shared, parts, order, rule)
    # Sums of hot n-grams leave with part -1 beside the others, so one pass over the texts makes both.
    scorer = _scorer(shared, parts, order, rule, blocks)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        if first.column("kind")[0].as_py() == 0:  # they come in groups of their own, a few to each
            made = _rows(list(_sum_rows(*_sum_up(chain([first], batches)), blocks)))
        else:
            made = scorer(pa.Table.from_batches([first, *batches]))
        yield from made.to_batches(max_chunksize=1)
        del first, made
        give_back()

    spread = F.when(F.col("kind") == 0, -1 - F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    made = stored(exploded.withColumn("part", spread).groupBy("part").applyInArrow(by_part, _SCHEMA), "scored")
    # Both sides come from one table, so one gets columns of its own before they meet.
    opened = made.filter("kind = 1")
    counted = made.filter("kind = 2").select(*[F.col(c).alias(c) for c in _NAMES])
    closed = opened.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_closer(rule.own, blocks), _SCHEMA)
    sums = made.filter("kind = 0").unionByName(closed)
    return sums.groupBy("part").applyInArrow(_summed, "id long, n_words long, log_score double")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: words, summed and mean logarithm of the scores."""
    found = scores(docs, key, text, **options).withColumnRenamed("id", "_id")
    ids = docs.select(key)
    joined = ids.join(found, F.coalesce(ids[key].cast("long"), F.lit(_NULL_ID)) == F.col("_id"), "left")
    return joined.select(
        key, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"),
        (F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )
