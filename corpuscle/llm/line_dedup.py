"""Fuzzy line deduplication: MinHash bands, exact Jaccard, distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_chunks, hot_join, linked_rows, map_arrow, materialize, sorted_groups, text_chunks, without
from .graph import connected_components
from .simhash import deal_tiles

#: Characters of a shingle by the length of a line: (characters, shortest line, longest line). Short lines have short
#: shingles, or one changed character would part them; lengths in two rows are compared both ways.
SHINGLES = ((3, 3, 51), (5, 44, 95), (8, 80, 1 << 40))
#: Bands of rows: at a similarity of 0.8 a pair shares no band in 0.3 % of cases, at 0.9 in one of 30,000.
BANDS, ROWS = 8, 3
SIMILARITY = 0.8
TILE = 512
#: Groups of more lines are verified one by one, smaller ones of one least line together (a power of two).
MANY = 64
#: Characters whose shingles a task holds at once; pairs of longer lines are compared one at a time.
_CHUNK, _MOST = 200_000, 400_000
#: Bytes of texts whose lines a task judges at once.
_TEXTS = 1 << 26
_P = np.uint32(0x01000193)
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def normal_form(line: str) -> str:
    """Lower-cased, with single spaces and none at the ends; what lines are compared by."""
    return " ".join(line.lower().split())


def line_hash(normal: str) -> int:
    return xxhash.xxh64_intdigest(normal.encode("utf-8", "replace")) - (1 << 63)


def shingles(normal: str, k: int) -> set[str]:
    return {normal[i : i + k] for i in range(len(normal) - k + 1)}


def similarity(a: str, b: str) -> float:
    """The largest Jaccard similarity of two normal forms over the shingle lengths that both lines have; 1 if they are equal."""
    best = float(a == b)
    for k, low, high in SHINGLES:
        if low <= len(a) <= high and low <= len(b) <= high:
            x, y = shingles(a, k), shingles(b, k)
            best = max(best, len(x & y) / len(x | y))
    return best


def _shingle_codes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and which places begin a shingle of ``k`` inside one line."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    n = len(codes) - k + 1
    inside = np.ones(n, bool)
    for j in range(1, k):
        at = ends[:-1] - j
        inside[at[at < n]] = False
    return codes, inside


def band_keys(lines: list[str], k: int) -> np.ndarray:
    """(lines, BANDS) keys; every line must have ``k`` or more characters."""
    if not lines:
        return np.zeros((0, BANDS), np.int64)
    out = np.empty((len(lines), BANDS), np.int64)
    for a, b in text_chunks(lines, _CHUNK):
        part = lines[a:b]
        codes, inside = _shingle_codes(part, k)
        n = len(inside)
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h *= _P
            h ^= codes[j : j + n]
        h = h[inside]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        starts = np.concatenate(([0], np.cumsum([len(x) - k + 1 for x in part])[:-1]))
        hashed = np.empty_like(h)
        for band in range(BANDS):
            key = np.full(len(part), 16 * k + band + 1, np.uint64)
            for j in range(band * ROWS, (band + 1) * ROWS):
                np.multiply(h, _A[j], out=hashed)
                hashed += _B[j]
                key ^= np.minimum.reduceat(hashed, starts)
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[a:b, band] = key.view(np.int64)
    return out


#: White space but for the space and the line feed.
_ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = ("  ", " \n", "\n ", *_ODD)


def normal_lines(text: str) -> list[str]:
    """``normal_form`` of each line. Most texts have no white space to mend, which is seen sooner than mended."""
    text = text.lower()
    lines = text.split("\n")
    if text.startswith(" ") or text.endswith(" ") or any(x in text for x in _UNEVEN):
        return [" ".join(x.split()) for x in lines]
    return lines


def _lines_of(text: str | None) -> list[str]:
    return [x for x in normal_lines(text or "") if x]


def with_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, hashes, owners, keys) of (doc_id, mark, text): per document, its lines and their band keys.

    ``keys`` are BANDS numbers of eight bytes for each of ``owners``, a line's
    hash; the last two bits of a key are its row of SHINGLES. They stand in the
    first document of a batch that has the line.
    """

    def run(batch):
        seen: set[int] = set()
        for a, b, texts in arrow_chunks(batch.column(2), _TEXTS):
            yield judged(batch.slice(a, b - a), texts, seen)

    def judged(batch, texts, seen):
        hashes, owners, fresh, of_doc = [], [], [], []
        for number, text in enumerate(texts):
            lines = _lines_of(text)
            marks = [line_hash(x) for x in lines]
            for m, x in zip(marks, lines):
                if m not in seen:
                    seen.add(m)
                    owners.append(m)
                    fresh.append(x)
                    of_doc.append(number)
            hashes.append(marks)
        sizes = np.array([len(x) for x in fresh], np.int64)
        at, made = [], []
        for number, (k, low, high) in enumerate(SHINGLES):
            of = np.flatnonzero((sizes >= low) & (sizes <= high))
            at.append(of)
            made.append(band_keys([fresh[i] for i in of.tolist()], k) & ~np.int64(3) | number)
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        at = at[order]
        counts = np.bincount(np.array(of_doc, np.int64)[at], minlength=batch.num_rows)
        columns = [_bytes_by(counts, np.array(owners, np.int64)[at], 8), _bytes_by(counts, np.concatenate(made)[order], 8 * BANDS)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), *columns], names=["doc_id", "mark", "hashes", "owners", "keys"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, mark long, hashes array<long>, owners binary, keys binary")


def _bytes_by(counts: np.ndarray, values: np.ndarray, width: int) -> pa.Array:
    """``values`` as bytes, ``counts`` times ``width`` of them in a row."""
    ends = np.concatenate(([0], np.cumsum(counts))) * width
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def candidate_groups(lines: DataFrame, tile: int = TILE) -> DataFrame:
    """(p, g, h, over): lines that share a band. Equal groups from several bands come once; ``over`` marks too large ones.

    ``p`` is a group's least line; groups of one p are verified in one task. The
    last two bits of ``g`` are the row of SHINGLES. A line has 2 * BANDS groups
    at most. Keys are dealt by parts of their range, those of a batch for one part
    in one row: nearly all stand alone, and arrays tell so.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 8 * tasks

    def deal(batch):
        owners, keys = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64) for i in (0, 1))
        for a in range(0, len(owners), _DEALT):
            yield dealt_keys(owners[a : a + _DEALT], keys[a * BANDS : (a + _DEALT) * BANDS])

    def dealt_keys(owners, keys):
        part = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        pairs = np.stack([keys[order], np.repeat(owners, BANDS)[order]], axis=1)
        counts = np.bincount(part, minlength=parts)
        named = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(named.astype(np.int32)), _bytes_by(counts[named], pairs, 16)], names=["part", "pairs"])

    def run(batches):
        part, shared = None, _Shared(tile)
        for batch in batches:
            of = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for a, b in zip(starts, [*starts[1:], len(of)]):
                if of[a] != part:
                    yield from shared.close()
                    part, shared = of[a], _Shared(tile)
                for x in batch.column(1).slice(a, b - a):
                    yield from shared.add(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2))
        yield from shared.close()

    dealt = map_arrow(lines.select("owners", "keys"), deal, "part int, pairs binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "p long, g long, h long, over boolean").distinct()


class _Shared:
    """Groups of the lines that have a key in common, of (key, line) pairs that come in any order.

    Of a key with more than ``tile`` lines none is held for long: they are handed
    on when ``most`` pairs have come, and later ones as well.
    """

    def __init__(self, tile: int, most: int = 1 << 21) -> None:
        self.tile, self.most = tile, most
        self.held: list[np.ndarray] = []
        self.rows = 0
        self.large = np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray):
        self.held.append(pairs)
        self.rows += len(pairs)
        if self.rows > self.most:
            key, line = np.concatenate(self.held).T
            order = np.lexsort((line, key))
            key, line, size = self._once(key[order], line[order])
            over = size > self.tile
            if over.any():
                self.large = np.union1d(self.large, key[over])
            over |= np.isin(key, self.large)
            yield from self._batches(key[over], key[over], line[over], True)
            self.held = [np.stack([key[~over], line[~over]], axis=1)]
            self.rows = len(self.held[0])
            self.most = max(self.most, 2 * self.rows)

    def close(self):
        if not self.held:
            return
        key, line = np.concatenate(self.held).T
        self.held = []
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key) + 1, bool)
        twin[1:-1] = key[1:] == key[:-1]
        alone = ~(twin[1:] | twin[:-1])
        if len(self.large):
            alone &= ~np.isin(key, self.large)
        key, line = key[~alone], line[order[~alone]]
        order = np.lexsort((line, key))
        key, line, size = self._once(key[order], line[order])
        over = size > self.tile
        if len(self.large):
            over |= np.isin(key, self.large)
        yield from self._batches(key[over], key[over], line[over], True)
        several = ~over & (size > 1)
        key, line, size = key[several], line[several], size[several]
        if not len(key):
            return
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = line.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        name = np.add.reduceat(mixed, starts).view(np.int64) & ~np.int64(3) | key[starts] & 3
        yield from self._batches(np.repeat(line[starts], size[starts]), np.repeat(name, size[starts]), line, False)

    @staticmethod
    def _once(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs without repeats, and of how many its key has."""
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line = key[new], line[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        return key, line, np.repeat(sizes, sizes)

    @staticmethod
    def _batches(p: np.ndarray, g: np.ndarray, h: np.ndarray, over: bool):
        for a in range(0, len(h), _ROWS):
            columns = [pa.array(x[a : a + _ROWS]) for x in (p, g, h)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), over))], names=["p", "g", "h", "over"])


#: Rows that a task gathers before it hands them on, and lines whose keys it deals at once.
_ROWS, _DEALT = 20_000, 200_000


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(edges, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


_PAIRS = [[(i, j) for i in range(n) for j in range(i + 1, n)] for n in range(MANY + 1)]


class _Verifier:
    """Edges that join the similar lines of groups (p, g, lines); groups of one p must come in a row.

    Lines of a p's smaller groups are compared together, so that a pair in several
    groups is looked at once, and the shingles of many p's are hashed together.
    Larger groups follow one by one; there, links are remembered until p changes.
    """

    def __init__(self, least: float) -> None:
        self.least = least
        self.last: int | None = None
        self.parent: dict[int, int] = {}
        self.waiting: dict[int, list[tuple[list[int], list[str], list[tuple[int, int]]]]] = {}
        self.groups: dict[int, list[tuple[list[int], list[str]]]] = {}
        self.lines = self.size = self.chars = 0

    def add(self, p: int, h: list[int], texts: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Takes a group and gives the edges that are ready."""
        if p != self.last:
            self._turn()
            self.last, self.parent = p, {}
        found: list[tuple[int, int]] = []
        if len(h) > MANY:
            return self._large(h, texts, k)
        size = sum(map(len, texts))
        if size > _MOST:
            for i in range(len(h)):
                for j in range(i):
                    if _root(self.parent, h[i]) != _root(self.parent, h[j]):
                        near = _similar_pairs([[texts[i], texts[j]]], [[(0, 1)]], k, self.least)[0]
                        found += _fresh(self.parent, near, [h[i], h[j]])
            return found
        if self.lines + len(h) > 4 * MANY or self.size + size > _MOST:
            self._turn()
        self.groups.setdefault(k, []).append((h, texts.tolist()))
        self.lines += len(h)
        self.size += size
        return self.close() if self.chars > _MOST // 2 else []

    def _turn(self) -> None:
        """Puts the groups of one p to the rest."""
        for k, groups in self.groups.items():
            units = self.waiting.setdefault(k, [])
            while groups:
                names, texts = groups.pop()
                pairs = _PAIRS[len(names)]
                if groups:
                    of = dict(zip(names, texts))
                    linked = {(names[i], names[j]) for i, j in pairs}
                    while groups and len(of) + len(groups[-1][0]) <= MANY:
                        names, texts = groups.pop()
                        of.update(zip(names, texts))
                        linked.update((names[i], names[j]) for i, j in _PAIRS[len(names)])
                    names, texts = list(of), list(of.values())
                    at = {x: i for i, x in enumerate(names)}
                    pairs = [(at[x], at[y]) for x, y in linked]
                units.append((names, texts, pairs))
                self.chars += sum(map(len, texts))
        self.groups, self.lines, self.size = {}, 0, 0

    def close(self) -> list[tuple[int, int]]:
        """All edges of the smaller groups that were taken."""
        self._turn()
        found: list[tuple[int, int]] = []
        for k, units in self.waiting.items():
            names, texts, pairs = zip(*units)
            for own, edges in zip(names, _similar_pairs(texts, pairs, k, self.least)):
                if edges:
                    found += _stars(edges, own)
        self.waiting, self.chars = {}, 0
        return found

    def _large(self, h: list[int], texts: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Edges of one group. Many large groups are copies of one line with a change in one place, which their ends show."""
        own = _root(self.parent, h[0])
        if all(_root(self.parent, y) == own for y in h[1:]):
            return []
        if all(_surely_similar(texts[0], t, k, self.least) for t in texts[1:]):
            return _fresh(self.parent, [(0, i) for i in range(1, len(h))], h)
        return _fresh(self.parent, _similar_rows(list(texts), k, self.least), h)


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)  # halves the way for the next call
        x = up
    return x


def _stars(edges: list[tuple[int, int]], names: list[int]) -> list[tuple[int, int]]:
    """Edges from each line to the first one of its component, by their names."""
    parent: dict[int, int] = {}
    for i, j in edges:
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(names[i], names[_root(parent, i)]) for i in list(parent) if _root(parent, i) != i]


def _fresh(parent: dict[int, int], edges: list[tuple[int, int]], names: list[int]) -> list[tuple[int, int]]:
    """Those of ``edges`` whose ends ``parent`` doesn't join already, by their names; it joins them."""
    found = []
    for i, j in edges:
        a, b = _root(parent, names[i]), _root(parent, names[j])
        if a != b:
            parent[b] = a
            found.append((names[i], names[j]))
    return found


def _shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of ``k`` characters, text by text, and where each text's end (from 0 on)."""
    codes, inside = _shingle_codes(texts, k)
    n = len(inside)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    h = mixed[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xA0761D6478BD642F)
        h += mixed[j : j + n]
    return h[inside], np.concatenate(([0], np.cumsum([len(t) - k + 1 for t in texts])))


def _similar_pairs(units: list[list[str]], pairs: list[list[tuple[int, int]]], k: int, least: float) -> list[list[tuple[int, int]]]:
    """Of each unit's ``pairs`` of lines those with a Jaccard similarity of ``least`` or more. A unit has two to MANY lines.

    The last bits of a shingle's hash give way to the number of its line, so that
    one sort of a unit brings equal shingles of all its lines together.
    """
    lines = np.array([len(u) for u in units])
    first = np.concatenate(([0], np.cumsum(lines)))
    hashes, ends = _shingle_hashes([t for u in units for t in u], k)
    own = (np.arange(first[-1]) - np.repeat(first[:-1], lines)).astype(np.uint64)
    hashes &= ~np.uint64(MANY - 1)
    hashes |= np.repeat(own, np.diff(ends))
    cuts = ends[first]
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        hashes[a:b].sort()
    step = hashes[1:] ^ hashes[:-1]
    new, same = np.ones(len(hashes), bool), np.zeros(len(hashes), bool)  # a line's shingle comes first; the one before has it, too
    np.not_equal(step, 0, out=new[1:])
    np.less(step, MANY, out=same[1:])
    new[cuts[:-1]], same[cuts[:-1]] = True, False
    line = (np.repeat(first[:-1], np.diff(cuts)) + (hashes & np.uint64(MANY - 1)).view(np.int64))[new]
    same = same[new]
    sizes = np.bincount(line, minlength=int(first[-1]))
    several = same.copy()
    several[:-1] |= same[1:]
    line, same = line[several], same[several]
    unit = np.repeat(np.arange(len(units)), lines)[line]
    number = np.cumsum(~same)
    common = np.bincount(unit[same], minlength=len(units))
    total = sizes[first[:-1]] + sizes[first[:-1] + 1]
    near = (common > 0) & (common >= least * (total - common))
    at = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
    found = []
    for u, n in enumerate(lines.tolist()):
        a, b, start = at[u], at[u + 1], int(first[u])
        if n == 2 or a == b:
            found.append(pairs[u] if n == 2 and near[u] else [])
            continue
        x, y = np.array(pairs[u]).T
        shared = _shared_bits(line[a:b] - start, number[a:b] - number[a], n, x, y)
        both = sizes[start + x] + sizes[start + y] - shared
        found.append([pairs[u][i] for i in np.flatnonzero((shared > 0) & (shared >= least * both)).tolist()])
    return found


def _shared_bits(line: np.ndarray, number: np.ndarray, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles lines ``x`` and ``y`` share, of (line, number of the shingle) by number."""
    shared = np.zeros(len(x), np.int64)
    for a in range(0, int(number[-1]) + 1, _WIDE):
        i, j = np.searchsorted(number, (a, a + _WIDE))
        has = np.zeros((n, int(number[j - 1]) + 1 - a), bool)
        has[line[i:j], number[i:j] - a] = True
        bits = np.packbits(has, axis=1)
        shared += np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
    return shared


#: Shingles that stand in one table of bits.
_WIDE = 1 << 15


def _surely_similar(a: str, b: str, k: int, least: float) -> bool:
    """Whether what two lines share at both ends proves a Jaccard similarity of ``least`` or more; False says nothing.

    Shingles that don't touch the parts between the common ends are in both sets,
    so at most ``apart`` are in one only; and some of a's shingles, counted
    without repeats, are no more than the union has.
    """
    n = min(len(a), len(b))
    start = _shared(a, b, n, lambda x, y, i, j: x.startswith(y[i:j], i))
    end = _shared(a, b, n - start, lambda x, y, i, j: x.endswith(y[len(y) - j : len(y) - i], 0, len(x) - i))
    apart = len(a) + len(b) - 2 * (start + end) + 2 * (k - 1)
    step = max(1, len(a) // (8 * apart))
    return apart <= (1 - least) * len({a[i : i + k] for i in range(0, len(a) - k + 1, step)})


def _shared(a: str, b: str, n: int, same) -> int:
    """The largest number up to ``n`` of characters that agree, found by halving."""
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if same(a, b, low, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _similar_rows(texts: list[str], k: int, least: float) -> list[tuple[int, int]]:
    """Edges (as ``_Verifier.edges``, by position) of a larger group: a text's shingles are counted in all others at once."""
    codes, inside = _shingle_codes(texts, k)
    n = len(inside)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), [len(t) - k + 1 for t in texts])
    h = h[inside]
    order = np.argsort(h)
    step = np.concatenate(([0], np.cumsum(np.diff(h[order]) != 0)))
    number = np.empty(len(h), np.int64)
    number[order] = step
    return linked_rows(owner, number, len(texts), int(step[-1]) + 1, least)


def similar_lines(docs: DataFrame, lines: DataFrame, least: float = SIMILARITY, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b) between the hashes of lines that join what exact Jaccard over whole lines links; they read tables that ``scratch`` holds."""
    scratch = scratch or Scratch(docs.sparkSession)
    groups = scratch.materialize(candidate_groups(lines, tile))

    def texts(batch):
        seen = {line_hash(x): x for t in batch.column(0).to_pylist() for x in _lines_of(t)}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.string())], names=["h", "line"])

    wanted = groups.select("h").distinct()
    found = scratch.materialize(map_arrow(docs.select("text"), texts, "h long, line string").join(wanted, "h").distinct())

    def verify(keys):
        def run(batches):
            verifier = _Verifier(least)
            found: list[tuple[int, int]] = []
            for group, _ in sorted_groups(batches, keys, "h", None, 2):
                k = SHINGLES[int(group["g"][0]) & 3][0]
                found += verifier.add(int(group[keys[0]][0]), group["h"].tolist(), group["line"], k)
                if len(found) >= _ROWS:
                    yield _edge_batch(found)
                    found = []
            found += verifier.close()
            if found:
                yield _edge_batch(found)

        return run

    # The work is in Python and not in bytes, so the number of tasks is stated and not merged by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = groups.where("not over").select("p", "g", "h").join(found, "h").select("p", "g", "h", "line")
    plain = plain.repartition(tasks, "p").sortWithinPartitions("p", "g", "h").mapInArrow(verify(["p", "g"]), "a long, b long")
    tiles = deal_tiles(groups.where("over").select("g", "h").distinct(), "g", "h", tile).join(found, "h").select("g", "i", "j", "h", "line")
    tiles = tiles.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j", "h").mapInArrow(verify(["g", "i", "j"]), "a long, b long")
    return plain.union(tiles)


def _marked(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """(doc_id, mark, text): ``mark`` names a row by its id, text and the columns in ``more``."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text, *more).alias("mark"), F.col(text).alias("text"))


def _rules(docs: DataFrame, lines: DataFrame, least: float, tile: int, scratch: Scratch) -> DataFrame:
    """(mark, hits) of (doc_id, mark, text) rows: for each of a row's lines that is repeated, its component and whether the row keeps it.

    ``lines`` and all that ``scratch`` holds are deleted then.
    """
    links = Scratch(docs.sparkSession)
    roots = connected_components(similar_lines(docs, lines, least, tile, links), scratch).select(F.col("node").alias("h"), "root")
    links.drop()
    occurs = lines.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark").alias("place"), F.explode("hashes").alias("h"))
    counted = occurs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(roots, "h", "left").where("root is not null or n > 1")
    rules = scratch.materialize(counted.select("h", "n", F.coalesce("root", "h").alias("root")))
    total = rules.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A line may stand in many documents and a component may hold many lines: both joins deal frequent keys apart.
    hits = materialize(hot_join(occurs, rules, "h", "n", total).where("root is not null"))
    scratch.drop()
    # Written, or the join would keep the dealing by root alone that the groups come in.
    by_root = materialize(hits.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("place").alias("first")))
    told = hot_join(hits, by_root, "root", "members", total)
    keeps = F.col("place.mark") == F.col("first.mark")
    return told.select("place.mark", F.struct("h", "root", keeps.alias("keeps")).alias("hit")).groupBy("mark").agg(F.collect_set("hit").alias("hits"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``docs`` with the repeated lines taken out, and ``n_lines``, ``n_removed``.

    Every line that isn't blank is judged by its normal form. Lines are linked if
    those are equal, or by a Jaccard similarity of ``similarity`` or more of their
    character shingles (of 3, 5 or 8 characters, by length). Of each component of
    linked lines one stays: the first one in the row with the smallest id (null
    ids come last; rows that share an id are told apart by their texts, equal rows
    by their place). No document is dropped; one that loses every line has an
    empty text. Blank lines stay, null texts stay null; an empty table gives no
    rows. Columns of the names made here are replaced.
    """
    docs = without(docs, "n_lines", "n_removed", "__mark", "__hits", "__row")
    names = docs.columns
    rows = _marked(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession)
    lines = scratch.materialize(with_lines(rows))
    mark = F.xxhash64(doc_id, text)
    if not lines.where("size(hashes) > 0").groupBy("mark").count().where("count > 1").isEmpty():
        docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))  # equal rows: a number names each
        rows = _marked(docs, doc_id, text, "__row")
        scratch.drop()
        lines = scratch.materialize(with_lines(rows))
        mark = F.xxhash64(doc_id, text, "__row")
    rules = _rules(rows, lines, similarity, tile, scratch).select(F.col("mark").alias("__mark"), "hits", F.lit(0).alias("__at"))
    blank = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    dealt = docs.withColumn("__own", mark).withColumn("__deal", F.when(blank, F.floor(F.rand(3) * 10_000).cast("int")).otherwise(0))
    joined = dealt.join(rules, (F.col("__own") == F.col("__mark")) & (F.col("__deal") == F.col("__at")), "left").select(*names, "hits")
    at = names.index(text)

    def run(batch):
        texts, totals, removed = [], [], []
        told = batch.column(len(names))
        places = told.offsets.to_pylist()
        h, roots, keep = (told.values.field(i).to_pylist() for i in range(3))
        for t, a, b in zip(batch.column(at).to_pylist(), places, places[1:]):
            n = t.count("\n") + 1 if t is not None else 0
            gone = 0
            if b > a:
                rule = dict(zip(h[a:b], zip(roots[a:b], keep[a:b])))
                used: set[int] = set()
                kept = []
                for line, normal in zip(t.split("\n"), normal_lines(t)):
                    root, keeps = rule.get(line_hash(normal), (None, True)) if normal else (None, True)
                    if root is None or (keeps and root not in used):
                        kept.append(line)
                    used.add(root)
                gone = n - len(kept)
                t = "\n".join(kept) if gone else t
            texts.append(t)
            totals.append(n)
            removed.append(gone)
        columns = batch.columns[: len(names)]
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"]
        )

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return map_arrow(joined, run, schema)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` after ``dedup_lines``, without the documents of which no word is left; columns are those of ``docs``.

    A document that lost no line stays as it is, whatever it holds.
    """
    left = dedup_lines(docs, doc_id, text, **options)
    return left.where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def brute_force(docs: list[tuple], least: float = SIMILARITY) -> list[str | None]:
    """The text left of each (id, text), by comparing all lines with all lines (small tables only)."""
    normals = sorted({x for _, t in docs for x in _lines_of(t)})
    parent = list(range(len(normals)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(normals):
        for j in range(i):
            if similarity(a, normals[j]) >= least:
                parent[find(i)] = find(j)
    of = {x: find(i) for i, x in enumerate(normals)}
    used: set[int] = set()
    out: dict[int, str | None] = {}
    for place in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)):
        t = docs[place][1]
        kept = []
        for line in (t or "").split("\n"):
            root = of.get(normal_form(line))
            if root is None or root not in used:
                kept.append(line)
            if root is not None:
                used.add(root)
        out[place] = None if t is None else "\n".join(kept)
    return [out[i] for i in range(len(docs))]
