"""Operator 2, SentencePiece encoding and decoding with Gumbel top-k segmentations.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces. The pieces'
weights are a Zipf law over their rank in the public vocabulary (nothing is trained); a character that
is no piece is its UTF-8 byte pieces. No piece goes on after a space has begun, so the lattice is a
chain of small ones, one a chunk (spaces and what follows them), and equal chunks share theirs.

Sampling k paths without replacement is the top k of Gumbel-perturbed path weights. Suffix sums give
each partial path's exact weight, so a perturbed A* search pops a partial path, extends it to its best
completion (the child with the greatest perturbed weight has its parent's) and leaves the siblings,
perturbed under the condition that none exceeds its parent, on the agenda; only the k best of those
can ever be popped. All siblings within one chunk stand on the agenda as one entry, as the greatest of
Gumbel variables is one itself, and are split by edges when it is popped. The best weight left gives
the inclusion probabilities. The random numbers are
hashes of row key, sample, chunk, place and edge: neither batches nor partitions change a result.

Defined cases: a null or empty text has one segmentation of no pieces; a text with fewer segmentations
than asked for gives them all; a null key is a key like any other; equal keys with equal texts give
equal samples; an empty table gives an empty result; further columns are ignored. Texts are taken
whole; memory grows with the longest text. Decoding returns every text exactly.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices

#: Characters whose chunks share one table of lattices, and chunks that are sampled at once.
LATTICE_CHARS, CHUNKS_AT_ONCE = 6_000_000, 150_000
_SHIFT = 21
_SLOT_BITS, _SLOT_FACTOR = 18, 0x9E3779B97F4A7C15


class Pieces:
    """A SentencePiece vocabulary as a trie for array look-ups, with weights and surfaces by id."""

    _shared: dict[tuple, Pieces] = {}

    @classmethod
    def shared(cls, path: str, power: float) -> Pieces:
        """This Python worker's copy."""
        if (path, power) not in cls._shared:
            cls._shared[path, power] = cls(path, power)
        return cls._shared[path, power]

    def __init__(self, path: str, power: float = 1.0):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.vocab_size())
        self.byte = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        surface = {i: p.id_to_piece(i).replace("▁", " ") for i in plain}
        self.surface = [surface[i].encode() if i in surface else b"" for i in ids]
        for b in range(256):
            self.surface[self.byte[b]] = bytes([b])
        rank = {i: r for r, i in enumerate(plain)}
        weight = np.array([-power * np.log(rank[i] + 10.0) if i in rank else 0.0 for i in ids])
        total = np.log(np.exp(weight[plain]).sum())
        self.weight = weight - total
        self.byte_weight = -power * np.log(len(plain) + 10.0) - total - 1.0
        self.depth = max(map(len, surface.values()))
        end, keys = {}, {}
        for i in plain:
            at = 0
            for c in surface[i]:
                at = keys.setdefault(at << _SHIFT | ord(c), len(keys) + 1)
            end[at] = i
        slots, held = np.array([*keys], np.int64), np.array([*keys.values()], np.int32)
        bits = max(_SLOT_BITS, len(keys).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_next = np.full((1 << bits) + len(keys), -1, np.int64), np.zeros((1 << bits) + len(keys), np.int32)
        at, left = self._slot(slots), np.arange(len(keys))
        while len(left):  # open addressing: the first of those that want a free slot has it, the others look at the next one
            free = left[self.slot_key[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            self.slot_key[at[free[first]]], self.slot_next[at[free[first]]] = slots[free[first]], held[free[first]]
            left = left[self.slot_key[at[left]] != slots[left]]
            at[left] += 1
        self.inner = np.zeros(len(keys) + 1, bool)  # states that a character can follow
        self.inner[slots >> _SHIFT] = True
        self.begin = np.zeros(0x110000, np.int32)  # by first character; 0: none
        for c in {s[0] for s in surface.values() if s}:
            self.begin[ord(c)] = keys[ord(c)]
        self.end = np.full(len(keys) + 1, -1, np.int32)
        self.end[list(end)] = list(end.values())
        self.bytes = pa.array(self.surface, pa.large_binary())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(_SLOT_FACTOR)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """States after one more character; 0: none."""
        key = state.astype(np.int64) << _SHIFT | char
        at = self._slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_next[at], 0)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] += 1
            found = self.slot_key[at[left]]
            fine = found == key[left]
            out[left[fine]] = self.slot_next[at[left[fine]]]
            left = left[~fine & (found >= 0)]
        return out

    def crcs(self, ids: np.ndarray, ends: np.ndarray) -> list[int]:
        """The crc32 of what each run of ``ids`` (up to its end) decodes to, as ``decode`` would have it."""
        taken = self.bytes.take(pa.array(ids))
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)[taken.offset :] if len(taken) else np.zeros(1, np.int64)
        data, cuts = memoryview(data or b""), at[ends].tolist()
        return [zlib.crc32(data[min(lo + 1, hi) : hi]) for lo, hi in zip([int(at[0]), *cuts], cuts)]

    def decode(self, ids) -> bytes:
        """UTF-8 of the text that was encoded."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of UTF-8 texts with a space before each (null or empty: no chunk), the number of
    each chunk in the order of the texts, and where each text's chunks end."""
    texts = texts.cast(pa.large_binary())
    words = pc.split_pattern(texts, " ")
    bare = pc.fill_null(pc.equal(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = words.flatten().dictionary_encode()
    number, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    del words, coded
    if bare.any():  # each would be one empty word
        number, ends = np.delete(number, ends[bare] - 1), ends - np.cumsum(bare)
    keep = number != (names.index(b"") if b"" in names else -1)
    keep[ends[ends > 0] - 1] = True  # an empty word is one more space before the next, or stands at the end
    spots = np.flatnonzero(keep)
    spaces = np.diff(spots, prepend=-1) - 1
    number, odd = number[spots], np.flatnonzero(spaces)
    if len(odd):
        kind, number[odd] = np.unique(spaces[odd] << 32 | number[odd], return_inverse=True)
        number[odd] += len(names)
        names += [b" " * (x >> 32) + names[x & 0xFFFFFFFF] for x in kind.tolist()]
    return [" " + x.decode("utf-8", "surrogatepass") for x in names], number, np.searchsorted(spots, ends)


class Lattices:
    """The lattices of distinct chunks: nodes, and for each node its edges (``first[i]`` on). Nodes stand
    by the characters left, longer chunks first, so those that are worked on together are neighbours."""

    def __init__(self, chunks: list[str], p: Pieces):
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        char = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        by = np.argsort(-size, kind="stable")
        wide = len(size) - np.concatenate([[0], np.cumsum(np.bincount(size))[:-1]])  # nodes with so many characters left
        level = np.cumsum(wide) - wide
        n, n_nodes = len(size), int(wide.sum())
        self.root = np.empty(n, np.int64)
        self.root[by] = level[size[by]] + np.arange(n)
        to_go = np.repeat(np.arange(len(wide), dtype=np.int32), wide)
        rank = np.arange(n_nodes) - np.repeat(level, wide)
        self.offset = (size[by][rank] - to_go).astype(np.int32)
        letter = np.zeros(n_nodes, np.int32)
        letter[n:] = char[np.cumsum(size)[by][rank[n:]] - to_go[n:]]
        down = np.arange(n_nodes, dtype=np.int32)  # the node after one character
        down[n:] -= np.repeat(wide[:-1], wide[1:]).astype(np.int32)
        del rank, char, to_go, by
        src, dst, piece, single = [], [], [], np.zeros(n_nodes, bool)
        at = np.arange(n, n_nodes, dtype=np.int32)
        state = p.begin[letter[n:]]
        at, state = at[state > 0], state[state > 0]
        here = at
        for d in range(p.depth):
            if d:
                state = p.step(state, letter[here])
                fine = np.flatnonzero(state)
                at, here, state = at[fine], here[fine], state[fine]
            after, ended = down[here], p.end[state]
            hit = np.flatnonzero(ended >= 0)
            src.append(at[hit])
            dst.append(after[hit])
            piece.append(ended[hit])
            if not d:
                single[at[hit]] = True
            more = np.flatnonzero(p.inner[state] & (after >= n))
            at, here, state = at[more], after[more], state[more]
        lone = n + np.flatnonzero(~single[n:])
        src.append(lone)
        dst.append(down[lone])
        piece.append(-letter[lone] - 1)
        self.count = np.zeros(n_nodes, np.int32)
        for x in src:  # no node stands twice in one of them
            self.count[x] += 1
        n_edges = sum(map(len, src))
        kind = np.int32 if n_edges < 1 << 31 else np.int64
        self.first = (np.cumsum(self.count) - self.count).astype(kind)
        self.dst, self.piece, fill = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32), self.first.copy()
        for x, y, z in zip(src, dst, piece):
            spot = fill[x]
            self.dst[spot], self.piece[spot] = y, z
            fill[x] += 1
        odd, c = spot, letter[lone]
        self.logp = p.weight[np.maximum(self.piece, 0)]  # weights, until a level's are worked out
        self.logp[odd] = p.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        del src, dst, piece, single, fill, down, letter, at, here, state, lone
        suffix = np.zeros(n_nodes)
        self.ref_edge, self.ref_log = np.full(n_nodes, -1, kind), np.zeros(n_nodes)  # the likeliest edge, and the log probability of following those
        cuts = np.cumsum(wide).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # from the chunks' ends back
            e0, e1 = int(self.first[lo]), int(self.first[hi]) if hi < n_nodes else n_edges
            seg, count, dst = self.first[lo:hi] - e0, self.count[lo:hi], self.dst[e0:e1]
            w = self.logp[e0:e1] + suffix[dst]
            top = np.maximum.reduceat(w, seg)
            tops = np.repeat(top, count)
            total = top + np.log(np.add.reduceat(np.exp(w - tops), seg))
            suffix[lo:hi] = total
            self.logp[e0:e1] = np.minimum(0.0, w - np.repeat(total, count))
            chosen = np.flatnonzero(w == tops)
            if len(chosen) > len(seg):
                chosen = chosen[np.searchsorted(chosen, seg)]
            self.ref_edge[lo:hi] = chosen + e0
            self.ref_log[lo:hi] = np.minimum(0.0, top - total) + self.ref_log[dst[chosen]]
        node, chunk, steps = self.root, np.arange(n), []
        self.ref_size = np.zeros(n, np.int64)
        while len(node):
            edge = self.ref_edge[node]
            chunk, edge = chunk[edge >= 0], edge[edge >= 0]
            steps.append((chunk, edge))
            self.ref_size[chunk] += 1
            node = self.dst[edge]
        self.ref_first = np.cumsum(self.ref_size) - self.ref_size
        self.ref_edges = np.empty(int(self.ref_size.sum()), kind)
        for k, (chunk, edge) in enumerate(steps):
            self.ref_edges[self.ref_first[chunk] + k] = edge

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the nodes, one node's after another's, and where each node's begin."""
        n = self.count[nodes]
        seg = np.cumsum(n, dtype=np.int64) - n
        return np.repeat(self.first[nodes] - seg, n) + np.arange(int(n.sum())), seg


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for each i."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _other_paths(t: Lattices, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, edge), in order, of a random path from each node of ``start`` that is not the one along
    the likeliest edges."""
    path, node, on_ref, found = np.arange(len(start)), start, np.ones(len(start), bool), []
    while len(path):
        edge, seg = t.edges(node)
        n = t.count[node]
        local = edge - np.repeat(t.first[node], n) + np.repeat(t.offset[node].astype(np.int64) << 6, n)
        noise = _unit(_mix(np.repeat(key[path], n) + local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        ref = edge == np.repeat(np.where(on_ref, t.ref_edge[node], -1), n)
        with np.errstate(divide="ignore"):
            weight = t.logp[edge] + np.where(ref, np.log(-np.expm1(t.ref_log[t.dst[edge]])), 0.0) - np.log(-np.log(noise))
        at_top = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, seg), n))
        at_top = at_top[np.searchsorted(at_top, seg)]
        found.append((path, edge[at_top]))
        on_ref, node = ref[at_top], t.dst[edge[at_top]]
        live = t.count[node] > 0
        path, node, on_ref = path[live], node[live], on_ref[live]
    path, edge = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(path, kind="stable")
    return path[order], edge[order]


def _seed(key) -> int:
    return xxhash.xxh64_intdigest(b"\0" if key is None else str(key).encode(), 17)


def _gumbel(*key) -> float:
    return -math.log(-math.log((_seed(key) + 0.5) / (2.0**64 + 1)))


def _conditioned(noisy: list[float], bound: float) -> list[float]:
    """Perturbed weights given that the greatest of them is ``bound``."""
    top, out = max(noisy), []
    for g in noisy:
        if g == top:
            out.append(bound)
            continue
        u = bound - g + math.log1p(-math.exp(g - top))
        out.append(bound - max(0.0, u) - math.log1p(math.exp(-abs(u))))
    return out


def _best(values: list[float], n: int) -> list[int]:
    """Where the ``n`` greatest stand, in order; the first of equal ones."""
    return sorted(sorted(range(len(values)), key=lambda i: -values[i])[:n])


def _split(t: Lattices, item: tuple, node: int, key: tuple, need: int) -> list[tuple]:
    """The ``need`` best agenda entries of all other segmentations of one chunk, whose greatest perturbed
    weight is the item's: one for each edge that leaves the path taken."""
    value, edges, lo, hi, logp, place = item
    found = []
    for i in range(lo, hi):
        first, taken = int(t.first[node]), int(edges[i])
        for e in range(first, first + int(t.count[node])):
            if e != taken:
                found.append((logp + float(t.logp[e]), i, e))
        logp += float(t.logp[taken])
        node = int(t.dst[taken])
    noisy = [w + _gumbel(*key, *at) for (w, _, _), at in zip(found, _local(t, found, lo))]
    values = _conditioned(noisy, value)
    return [(values[j], np.append(edges[:i], e), w, int(t.dst[e]), place) for j in _best(values, need) for w, i, e in [found[j]]]


def _local(t: Lattices, found: list[tuple], lo: int) -> list[tuple[int, int]]:
    """(step in the chunk, target and piece) of edges, free of where the lattice stands in memory."""
    return [(i - lo, int(t.offset[t.dst[e]]) << 32 | (int(t.piece[e]) & 0xFFFFFFFF)) for _, i, e in found]


def _finish(t: Lattices, item: tuple, key: tuple, need: int) -> tuple[np.ndarray, float, list[tuple]]:
    """An entry's chunk completed at random: its edges, their log probability, and the ``need`` best siblings left."""
    value, edges, logp, node, place = item
    more, left = [], []
    while n := int(t.count[node]):
        first = int(t.first[node])
        each = range(first, first + n)
        at = int(t.offset[node])
        noisy = [logp + float(t.logp[e]) + _gumbel(*key, at, int(t.offset[t.dst[e]])) for e in each]
        values = _conditioned(noisy, value)
        best = max(range(n), key=noisy.__getitem__)
        for k, e in enumerate(each):
            if k != best:
                left.append((values[k], len(more), e, logp + float(t.logp[e])))
        more.append(first + best)
        logp += float(t.logp[first + best])
        node = int(t.dst[first + best])
    kept = [left[j] for j in _best([x[0] for x in left], need)]
    return np.concatenate([edges, np.array(more, np.int64)]), logp, [(v, np.concatenate([edges, np.array([*more[:n], e], np.int64)]), w, int(t.dst[e]), place) for v, n, e, w in kept]


def _sample_docs(t: Lattices, which: list[np.ndarray], seeds: list[int], k: int) -> list[list]:
    """For each text (its chunks' numbers) up to ``k`` of (edges, log probability, perturbed weight),
    and last the perturbed weight of the one that would come next.

    Agenda entries: (weight, edges so far, their log probability, next node, chunk) for one edge, and
    (weight, path, from, to, log probability before, chunk) for all other segmentations of a chunk."""
    out: list[list] = [[] for _ in which]
    agenda: list[list[tuple]] = [[(_gumbel(s, "root"), np.zeros(0, np.int64), 0.0, -1, -1)] for s in seeds]
    for sample in range(k):
        todo, need = [], k - sample
        for d, a in enumerate(agenda):
            if not a:
                continue
            item = a.pop(0)
            if len(item) == 6:
                a += _split(t, item, int(t.root[which[d][item[5]]]), (seeds[d], "split", sample, item[5]), need + 1)
                a.sort(key=lambda x: -x[0])
                item = a.pop(0)
            value, edges, logp, node, place = item
            if node >= 0:
                edges, logp, left = _finish(t, item, (seeds[d], "finish", sample, place), need)
                a += left
            todo.append((d, value, edges, logp, place + 1))
        if not todo:
            break
        rest = [which[d][place:] for d, _, _, _, place in todo]
        size = np.fromiter(map(len, rest), np.int64, len(rest))
        owner, occ = np.repeat(np.arange(len(todo)), size), np.concatenate(rest)
        place = _spread(np.array([x[4] for x in todo]), size)
        seed = np.array([_seed((seeds[x[0]], sample)) for x in todo], np.uint64)
        key = _mix(seed[owner] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        logp, length = t.ref_log[t.root[occ]], t.ref_size[occ]
        other = np.flatnonzero(_unit(_mix(key + np.uint64(1))) >= np.exp(logp))
        if len(other):
            path, edge = _other_paths(t, t.root[occ[other]], _mix(key[other] + np.uint64(3)))
            length[other] = np.bincount(path, minlength=len(other))
            logp[other] = np.bincount(path, t.logp[edge], minlength=len(other))
        ends = np.cumsum(length)
        flat = np.empty(int(length.sum()), np.int64)
        ref = np.ones(len(occ), bool)
        ref[other] = False
        flat[_spread((ends - length)[ref], length[ref])] = t.ref_edges[_spread(t.ref_first[occ[ref]], length[ref])]
        if len(other):
            flat[_spread((ends - length)[other], length[other])] = edge
        cuts = np.concatenate([[0], np.cumsum(size)])
        before, after = np.empty(len(occ)), [x[3] for x in todo]
        for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):  # sums of a text's own: the same in any batch
            if hi > lo:
                upto = np.cumsum(np.concatenate([[after[j]], logp[lo:hi]]))
                before[lo:hi], after[j] = upto[:-1], float(upto[-1])
        with np.errstate(divide="ignore"):  # a chunk's other segmentations together; their greatest weight rises with this
            rank = before + np.log(-np.expm1(np.minimum(logp, 0.0))) - np.log(-np.log(_unit(_mix(key + np.uint64(2)))))
        for j, (d, value, edges, _, first) in enumerate(todo):
            lo, hi = int(cuts[j]), int(cuts[j + 1])
            begin = int(ends[lo - 1]) if lo else 0
            whole = np.concatenate([edges, flat[begin : int(ends[hi - 1]) if hi else 0]]) if hi > lo else edges
            out[d].append((whole, after[j], value))
            r = rank[lo:hi]
            for q in (np.argpartition(-r, need - 1)[:need] if len(r) > need else np.arange(len(r))).tolist():
                if r[q] > -np.inf:
                    stop = int(ends[lo + q]) - begin + len(edges)
                    weight = value - float(np.logaddexp(0.0, value - r[q]))
                    agenda[d].append((weight, whole, stop - int(length[lo + q]), stop, float(before[lo + q]), first + q))
            agenda[d].sort(key=lambda x: -x[0])
            del agenda[d][need:]
    for d, a in enumerate(agenda):
        out[d].append(a[0][0] if a else -np.inf)
    return out


def _to_ids(t: Lattices, paths: list[np.ndarray], p: Pieces) -> list[np.ndarray]:
    """The ids of each path of edges."""
    ids = t.piece[np.concatenate(paths)]
    ends = np.cumsum([*map(len, paths)])
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        chars, kind = np.unique(-ids[odd] - 1, return_inverse=True)
        parts = [p.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in chars.tolist()]
        length = np.array([*map(len, parts)])
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = length[kind]
        upto = np.cumsum(sizes)
        ids = np.repeat(ids, sizes)
        ids[_spread((upto - sizes)[odd], length[kind])] = np.concatenate(parts)[_spread((np.cumsum(length) - length)[kind], length[kind])]
        ends = upto[ends - 1]
    return np.split(ids, ends[:-1])


def segment(texts: list[str] | pa.Array, keys: list, k: int, p: Pieces):
    """For each text up to ``k`` distinct sampled segmentations as (ids, log probability, perturbed
    weight, log inclusion probability), best perturbed weight first."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([x.encode("utf-8", "surrogatepass") for x in texts], pa.large_binary())
    names, number, ends = _chunks(texts)
    which = np.split(number, ends[:-1]) if len(ends) else []
    t = Lattices(names, p) if names else None
    del names
    at = 0
    while at < len(which):
        to, n = at, 0
        while to < len(which) and (to == at or n + len(which[to]) < CHUNKS_AT_ONCE):
            n += len(which[to])
            to += 1
        full = [i for i in range(at, to) if len(which[i])]
        found = dict(zip(full, _sample_docs(t, [which[i] for i in full], [_seed(keys[i]) for i in full], k))) if full else {}
        paths = [edges for samples in found.values() for edges, *_ in samples[:-1]]
        ids = iter(_to_ids(t, paths, p) if paths else [])
        for i in range(at, to):
            if i not in found:
                yield [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
                continue
            *samples, left = found.pop(i)
            rows = []
            for _, logp, score in samples:
                x = logp - left
                inclusion = 0.0 if x > 4 else (x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
                rows.append((next(ids), logp, score, inclusion))
            yield rows
        at = to


def sample(docs: DataFrame, model: str, k: int = 2, power: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, sample, ids, n_tokens, log_prob, perturbed, log_inclusion, text_crc32)``, ``k`` or
    fewer a text; the last is the crc32 of the UTF-8 of what the ids decode to."""
    names = [id_col, "sample", "ids", "n_tokens", "log_prob", "perturbed", "log_inclusion", "text_crc32"]

    def run(batch: pa.RecordBatch):
        p = Pieces.shared(model, power)
        for part in text_slices(batch, 1, LATTICE_CHARS):
            rows = segment(part.column(1), part.column(0).to_pylist(), k, p)
            ids, number, scores, at, held = [], [], [], [], 0
            for i, found in enumerate(rows):
                for s, (x, *score) in enumerate(found):
                    ids.append(x)
                    number.append(s + 1)
                    scores.append(score)
                    at.append(i)
                    held += len(x)
                if held > 1_000_000 or i + 1 == part.num_rows:
                    sizes, flat = np.array([*map(len, ids)], np.int64), np.concatenate(ids)
                    crc = p.crcs(flat, np.cumsum(sizes))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                    cols = [part.column(0).take(pa.array(at)), pa.array(number, pa.int32()), lists, pa.array(sizes), *(pa.array([x[c] for x in scores], pa.float64()) for c in range(3)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    ids, number, scores, at, held = [], [], [], [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, sample int, ids array<int>, n_tokens long, log_prob double, perturbed double, log_inclusion double, text_crc32 long")


def encode(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the library's own, deterministic encoding of each text in ``out_col``."""

    @F.pandas_udf("array<int>")
    def run(texts):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        return texts.map(lambda t: p.encode(t or "", num_threads=1))

    return docs.withColumn(out_col, run(F.col(text_col)))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of each id array in ``out_col``; a null array gives the empty text."""

    @F.pandas_udf("string")
    def run(ids):
        p = Pieces.shared(model, 1.0)
        return ids.map(lambda x: "" if x is None else p.decode(x).decode("utf-8", "replace"))

    return rows.withColumn(out_col, run(F.col(ids_col)))
