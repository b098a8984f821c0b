"""SentencePiece encoding with sampled segmentations, without replacement, and decoding.

Distribution: a unigram model over the vocabulary of a SentencePiece file. That file's scores are merge ranks, so a
piece's probability follows Zipf's law over its rank: log p = -log(2 + rank), where rank is the score's distance from 0;
a character that no piece covers is spelt in byte pieces of log p = BYTE_LOGP each. As in SentencePiece, spaces become
marks and one more is put in front of every text, which decoding takes away; a text's lattice is the chain of the
lattices of its segments, each of which starts at a mark.

Search: Gumbel top-k over the complete segmentations of the whole text, as a perturbed A-star search. A node of the
search tree is a set of segmentations (all that continue a prefix, but for excluded next pieces); its key is the largest
perturbed log probability within, which is a Gumbel variable at the set's log mass, truncated below its parent's key.
Backward sums over the lattice give exact masses, so the bound is tight: the best node is followed straight to its leaf,
and the sets left beside that path go back to the queue. All sets in the queue lie below the last key, and the largest
of their keys is again a truncated Gumbel at the log of their total mass, while the set that attains it is drawn in
proportion to mass; the queue is therefore held as masses, without a variable for each of thousands of siblings.

Inclusion: with the (k+1)-th key as threshold, a segmentation s is included with probability
1 - exp(-exp(log p(s) - threshold)); its logarithm is returned. Random numbers are hashes of (seed, row key, place), so
they don't depend on batches, partitions or retries.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_arrow, slices, store, table
from .unigram import MARK, model_path, pieces

K = 2
SEED = 20
BYTE_LOGP = -14.0
SLICE_BYTES = 2 << 20
#: Cells (word, place, length) of lattices that are solved at a time, and of those that a worker keeps for later slices.
CELLS, KEPT_CELLS = 1 << 20, 2 << 20
#: Occurrences in a worker's first slice that make it keep a word's lattice.
OFTEN = 3
#: Prefixes below this probability are not followed further for siblings: all their mass is below double precision.
LEAST_MASS = 1e-16
WIDE = 255
U = np.uint64
#: A product with a word of byte flags has their number in the top byte.
NUMBER = U(0x0101010101010101)
#: Parts segments; texts that hold it take a pattern instead.
CUT = "\x00"


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashed(*parts) -> np.ndarray:
    h = U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix(h + np.asarray(p).astype(np.uint64) * U(0xD1342543DE82EF95) + U(0x632BE59BD9B4E019))
    return h


def uniform(*parts) -> np.ndarray:
    """In (0, 1), from integers."""
    h = hashed(*parts)
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """What decoding needs of a vocabulary: the bytes of its pieces, spaces for marks."""

    def __init__(self, path: str):
        each = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(MARK, " ").encode() for t, _, k in pieces(path)]
        self.size = np.array([len(x) for x in each])
        self.bytes, self.first = np.frombuffer(b"".join(each), np.uint8), np.cumsum(self.size) - self.size

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of id lists: byte pieces are joined, marks are spaces, and the mark put in front goes."""
        if not lists:
            return []
        ids = np.concatenate(lists).astype(np.int64)
        n = self.size[ids]
        ends = np.cumsum(n)
        raw = self.bytes[np.repeat(self.first[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        stop = np.append(0, ends)[np.cumsum([len(x) for x in lists])].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stop], stop)]
        return [t[1:] if t[:1] == " " else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all([np.asarray(ids, np.int64)])[0]


class Lattices(Pieces):
    """The vocabulary's trie as a dense table over the WIDE commonest characters, and sums over segments' lattices."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = pieces(path)
        self.byte = np.zeros(256, np.int32)
        normal = []
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == 6:
                self.byte[int(piece[3:5], 16)] = i
            elif kind == 1 and MARK not in piece[1:]:
                normal.append((i, piece, score))
        weight = {i: -math.log(2 - score) for i, _, score in normal}
        total = math.log(sum(map(math.exp, weight.values())))
        self.logp = np.full(len(vocabulary), BYTE_LOGP)
        for i, w in weight.items():
            self.logp[i] = w - total
        self.p = np.append(np.exp(self.logp), 0.0)  # the id -1 stands for none
        self.longest = max(len(p) for _, p, _ in normal)
        seen: dict[str, int] = {}
        for _, piece, score in normal:
            for c in piece:
                seen[c] = seen.get(c, 0) + 1
        common = sorted(seen, key=lambda c: (-seen[c], c))[:WIDE]
        self.of_char = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(common):
            self.of_char[ord(c)] = k + 1
        self.rare = frozenset(seen) - frozenset(common)
        self.by_piece = {p: i for i, p, _ in normal}
        edges: dict[tuple[int, int], int] = {}
        ends, n = {}, 1
        for i, piece, _ in normal:
            node = 0
            for c in piece:
                k = int(self.of_char[ord(c)])
                if not k:
                    break
                if (node, k) not in edges:
                    edges[node, k] = n
                    n += 1
                node = edges[node, k]
            else:
                ends[node] = i
        self.next = np.zeros((n, WIDE + 1), np.int32)
        for (node, k), to in edges.items():
            self.next[node, k] = to
        self.end = np.full(n, -1, np.int32)
        for node, i in ends.items():
            self.end[node] = i

        self.is_rare = np.zeros(0x110000, bool)
        self.is_rare[[ord(c) for c in self.rare]] = True
        #: A line end that no piece holds is a segment of its own.
        self.cut_lines = "\n" not in seen
        self.kept: dict[str, int] | None = None
        self.kept_groups: list[tuple] = []

    def cut(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(segments of each text, distinct segments, number of each segment)."""
        if any(CUT in t for t in texts):
            lists = [self.segments(t) for t in texts]
            every, sizes = pa.array([w for x in lists for w in x], pa.string()), np.array([len(x) for x in lists], np.int64)
        else:
            marked = pc.replace_substring(pa.array([MARK + t if t else "" for t in texts], pa.string()), " ", MARK)
            marked = pc.replace_substring(marked, MARK, CUT + MARK)
            if self.cut_lines:
                marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
            lists = pc.split_pattern(marked, CUT)
            every = lists.flatten()
            some = np.asarray(pc.binary_length(every)) > 0
            sizes = np.bincount(np.asarray(pc.list_parent_indices(lists))[some], minlength=len(texts))
            every = every.filter(pa.array(some))
        coded = every.dictionary_encode()
        return sizes.astype(np.int64), coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)

    def segments(self, text: str) -> list[str]:
        """Whose lattices follow each other: every mark starts one, and line ends stand alone."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.cut_lines else f"{MARK}[^{MARK}]*", marked)

    def solve(self, words: list[str]) -> list[tuple]:
        """Groups of words of like length: (their indices, ids [word, place, length], cumulative probabilities, log sums)."""
        if not words:
            return []
        n = np.fromiter(map(len, words), np.int64, len(words))
        rare = np.zeros(len(words), bool)
        if self.rare:
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.nonzero(self.is_rare[codes])[0]
            rare[np.searchsorted(np.cumsum(n), at, side="right")] = True
        step = np.where(n <= 24, 4, 1 << np.maximum(2, np.frexp(n)[1] - 4))  # an eighth of the length at most
        width = -(-n // step) * step
        out = []
        for key in np.unique(width * 2 + rare).tolist():
            at = np.nonzero(width * 2 + rare == key)[0]
            most = max(1, CELLS // (key // 2 * min(self.longest, key // 2)))
            for i in range(0, len(at), most):
                part = at[i : i + most]
                out.append(self._group(part, [words[j] for j in part.tolist()], key // 2, bool(key % 2)))
        return out

    def _group(self, at: np.ndarray, words: list[str], width: int, has_rare: bool) -> tuple:
        n, most = len(words), min(self.longest, width)
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        size = np.array([len(w) for w in words])
        inside = np.arange(width)[None, :] < size[:, None]
        kinds = np.zeros((n, width + most), np.uint8)
        kinds[:, :width] = np.where(inside, self.of_char[codes], 0)
        row, place = np.nonzero(kinds[:, :width])
        node = np.zeros(len(row), np.int32)
        matches = []  # by length
        for length in range(most):
            node = self.next[node, kinds[row, place + length]]
            alive = node > 0
            row, place, node = row[alive], place[alive], node[alive]
            end = self.end[node]
            some = end >= 0
            matches.append((row[some], place[some], end[some]))
            if not len(row):
                break
        m = most if has_rare else max([k + 1 for k, x in enumerate(matches) if len(x[0])], default=1)
        m = -(-m // 8) * 8  # whole words of flags
        ids = np.full((n, width, m), -1, np.int32)
        for length, (row, place, end) in enumerate(matches[:m]):
            ids[row, place, length] = end
        for i, w in enumerate(words if has_rare else ()):
            for a in range(len(w)):
                for length in range(min(most, len(w) - a)):
                    ids[i, a, length] = self.by_piece.get(w[a : a + length + 1], -1)
        unknown = inside & (ids[:, :, 0] < 0)  # spelt in bytes; the id -2 - byte length stands for them
        spelt = np.ones_like(codes) if not unknown.any() else 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        single = np.where(unknown, spelt * BYTE_LOGP, self.logp[ids[:, :, 0]])
        # Places run first and words last, so that every step is a sweep over all words.
        own = np.where(inside, single, -np.inf).T
        steps = np.ascontiguousarray(ids.transpose(1, 2, 0))
        within = np.empty((width, m, n), np.float32)
        if -np.where(inside, single, 0.0).sum(axis=1).min(initial=0.0) < 600:  # sums fit doubles as they are
            p = self.p[steps]
            p[:, 0, :] = np.exp(own)
            sums = np.zeros((width + m + 1, n))
            sums[size, np.arange(n)] = 1.0
            for a in range(width - 1, -1, -1):
                e = p[a]
                e *= sums[a + 1 : a + 1 + m]
                np.cumsum(e, axis=0, out=e)
                whole = e[-1]
                np.copyto(sums[a], whole, where=inside[:, a])
                np.divide(e, np.where(whole > 0, whole, 1.0), out=within[a], casting="same_kind")
            with np.errstate(divide="ignore"):
                logs = np.log(sums)
        else:
            logp = np.where(steps >= 0, self.logp[steps], -np.inf)
            logp[:, 0, :] = own
            logs = np.full((width + m + 1, n), -np.inf)
            logs[size, np.arange(n)] = 0.0
            for a in range(width - 1, -1, -1):
                x = np.where(inside[:, a], logp[a] + logs[a + 1 : a + 1 + m], -np.inf)
                top = x.max(axis=0)
                top = np.where(np.isfinite(top), top, 0.0)
                e = np.cumsum(np.exp(x - top), axis=0)
                whole = e[-1]
                ok = whole > 0
                logs[a, ok] = top[ok] + np.log(whole[ok])
                within[a] = e / np.where(ok, whole, 1.0)
        cumulative, logs = np.ascontiguousarray(within.transpose(2, 0, 1)), np.ascontiguousarray(logs.T)
        ids[:, :, 0] = np.where(unknown, np.where(spelt == 1, self.byte[codes & 0xFF], -2 - spelt.astype(np.int32)), ids[:, :, 0])
        return at, ids, cumulative, logs, codes, size


def lattices(path: str) -> Lattices:
    return store(("lattices", path), lambda: Lattices(path))


class Slice:
    """A few documents whose segments are sampled together."""

    def __init__(self, lat: Lattices, keys: np.ndarray, texts: list[str], seed: int):
        self.lat, self.keys, self.seed = lat, keys, seed
        self.sizes, words, word = lat.cut(texts)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n = len(word)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.rank = np.arange(self.n) - self.first[self.doc]
        group_of, row_of = self._solved(words, np.bincount(word, minlength=len(words)))
        # All groups' tables as flat arrays: an edge is base + place * m + length, a node's log sum log_base + place.
        widths, self.m = (np.array([g[1].shape[i] for g in self.groups], np.int64) for i in (1, 2))
        n_rows = np.array([len(g[1]) for g in self.groups], np.int64)
        cells, spans = n_rows * widths * self.m, n_rows * (widths + self.m + 1)
        empty = np.zeros(0, np.int32)
        self.flat_ids = np.concatenate([empty, *(g[1].ravel() for g in self.groups)])
        self.flat_logs = np.concatenate([np.zeros(0), *(g[3].ravel() for g in self.groups)])
        at_ids, at_logs = np.cumsum(cells) - cells, np.cumsum(spans) - spans
        for i in range(len(self.lat.kept_groups), len(self.groups)):  # one copy is enough
            at, ids, cumulative, logs, codes, size = self.groups[i]
            self.groups[i] = (at, self.flat_ids[at_ids[i] : at_ids[i] + ids.size].reshape(ids.shape), cumulative, self.flat_logs[at_logs[i] : at_logs[i] + logs.size].reshape(logs.shape), codes, size)
        self.group, self.row = group_of[word], row_of[word]
        self.base = ((np.cumsum(cells) - cells)[group_of] + row_of * (widths * self.m)[group_of])[word]
        log_base = (np.cumsum(spans) - spans)[group_of] + row_of * (widths + self.m + 1)[group_of]
        self.log_base = log_base[word]
        zero = self.flat_logs[log_base]
        self.log_sum = np.bincount(self.doc, zero[word], len(texts))
        self.key = keys.astype(np.uint64)[self.doc] if self.n else np.zeros(0, np.uint64)

    def _solved(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and row of each word; the lattices of common words are kept from a worker's first slice on."""
        lat = self.lat
        if lat.kept is None:
            cells = np.cumsum([len(w) * min(lat.longest, len(w)) for w in words] * (times >= OFTEN))
            hot = [w for w, k, c in zip(words, times.tolist(), cells.tolist(), strict=True) if k >= OFTEN and c <= KEPT_CELLS]
            lat.kept_groups = lat.solve(hot)
            lat.kept = {}
            for g, (part, *_) in enumerate(lat.kept_groups):
                for row, i in enumerate(part.tolist()):
                    lat.kept[hot[i]] = g << 32 | row
        place = np.fromiter((lat.kept.get(w, -1) for w in words), np.int64, len(words))
        new = np.nonzero(place < 0)[0]
        found = lat.solve([words[i] for i in new.tolist()])
        self.groups = lat.kept_groups + found
        group_of, row_of = (place >> 32).astype(np.int32), place & 0xFFFFFFFF
        for g, (at, *_) in enumerate(found, len(lat.kept_groups)):
            group_of[new[at]], row_of[new[at]] = g, np.arange(len(at))
        return group_of, row_of

    def sample(self, number: int, forced: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Segment occurrence, step, place, length index, id, log p of every edge taken, in the text's order.

        forced: occurrences, steps and length indices that are given; an occurrence's steps follow each other from 0.
        """
        found = []
        key = hashed(self.seed, number, self.key, self.rank)
        order = np.argsort(self.group, kind="stable")
        ends = np.cumsum(np.bincount(self.group, minlength=len(self.groups)))
        given_n = np.bincount(forced[0], minlength=self.n) if len(forced[0]) else None
        if given_n is not None:
            by_place = np.lexsort((forced[1], forced[0]))
            given, given_at = forced[2][by_place], np.cumsum(given_n) - given_n
        for g, (_, ids, cumulative, _, _, size) in enumerate(self.groups):
            occ = order[ends[g - 1] if g else 0 : ends[g]]
            place = np.zeros(len(occ), np.int64)
            width, m = ids.shape[1:]
            flat_ids, rows = ids.reshape(-1), cumulative.reshape(-1, m)
            base, mine, size = self.row[occ] * width, key[occ], size[self.row[occ]]
            occ = occ.astype(np.int32)
            step = 0
            while len(occ):
                node = base + place
                u = (mix(mine + U(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
                flags = (rows.take(node, axis=0) <= u[:, None]).view(np.uint64) * NUMBER >> U(56)
                length = np.minimum(flags.sum(axis=1, dtype=np.int64) if m > 8 else flags.ravel().astype(np.int64), m - 1)
                if given_n is not None:
                    told = np.nonzero(given_n[occ] > step)[0]
                    if len(told):
                        length[told] = given[given_at[occ[told]] + step]
                edge = node * m + length
                id_ = flat_ids[edge]
                bad = np.nonzero(id_ == -1)[0]  # rounding at the end of a cumulative row
                while len(bad):
                    length[bad] -= 1
                    id_[bad] = flat_ids[node[bad] * m + length[bad]]
                    bad = bad[id_[bad] == -1]
                found.append((occ, np.full(len(occ), step, np.int32), place.astype(np.int32), length.astype(np.int32), id_))
                place = place + length + 1
                on = np.nonzero(place < size)[0]
                occ, place, base, mine, size = occ[on], place[on], base[on], mine[on], size[on]
                step += 1
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        occ, step, place, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        steps = np.bincount(occ, minlength=self.n)
        at = np.empty(len(occ), np.int64)
        at[(np.cumsum(steps) - steps)[occ] + step] = np.arange(len(occ))
        return tuple(x.take(at) for x in (occ, step, place, length, ids))

    def edge_logp(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.lat.logp[ids], (-2 - ids) * BYTE_LOGP)

    def conditional(self, occ, place, length) -> np.ndarray:
        """Probability of each edge given its node."""
        ids = self.flat_ids[self.base[occ] + place * self.m[self.group[occ]] + length]
        node = self.log_base[occ] + place
        return np.minimum(np.exp(self.edge_logp(ids) + self.flat_logs[node + length + 1] - self.flat_logs[node]), 1.0)

    def edges(self, o: int, place: int) -> list[tuple[int, float]]:
        """(length index, probability) of all edges that leave a node."""
        _, ids, _, logs, _, _ = self.groups[self.group[o]]
        r = self.row[o]
        k = np.nonzero(ids[r, place] != -1)[0]
        p = np.exp(self.edge_logp(ids[r, place, k]) + logs[r, place + k + 1] - logs[r, place])
        return list(zip(k.tolist(), p.tolist(), strict=True))

    def spelt(self, path: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(document, id) of all ids, byte pieces written out."""
        occ, _, place, _, ids = path
        doc = self.doc[occ]
        if not (ids < 0).any():
            return doc, ids
        times = np.where(ids < 0, -2 - ids, 1)
        out, at = np.repeat(ids, times), np.cumsum(times) - times
        for i in np.nonzero(ids < 0)[0]:
            _, _, _, _, codes, _ = self.groups[self.group[occ[i]]]
            raw = chr(codes[self.row[occ[i]], place[i]]).encode("utf-8", "replace").ljust(times[i], b"?")[: times[i]]
            out[at[i] : at[i] + times[i]] = self.lat.byte[np.frombuffer(raw, np.uint8)]
        return np.repeat(doc, times), out


class Queue:
    """A document's search queue: for each sampled path the sets that branch off its nodes, by mass."""

    def __init__(self):
        self.masses: list[np.ndarray] = []
        #: Of each path: its edges as arrays (occurrence, step, place, length index), prefix masses, and by branching
        #: node the excluded length indices if they are more than the path's own.
        self.paths: list[tuple] = []

    def mass(self) -> float:
        return float(sum(m.sum() for m in self.masses))

    def pop(self, u: float) -> tuple[int, int]:
        """(path, node) of a set drawn in proportion to mass."""
        totals = np.array([m.sum() for m in self.masses])
        left = u * totals.sum()
        i = min(int(np.searchsorted(np.cumsum(totals), left)), len(totals) - 1)
        while not totals[i] > 0:
            i -= 1
        left -= totals[:i].sum()
        j = min(int(np.searchsorted(np.cumsum(self.masses[i]), left)), len(self.masses[i]) - 1)
        while not self.masses[i][j] > 0:
            j -= 1
        return i, j


def top_k(lat: Lattices, keys: np.ndarray, texts: list[str], k: int, seed: int):
    """Yields (document, rank, ids, log p, key, log inclusion) in the order of documents and ranks."""
    part = Slice(lat, keys, texts, seed)
    n = len(texts)
    queues = [Queue() for _ in range(n)]
    key = -np.log(-np.log(uniform(seed, 0, keys, 1, 7)))  # of the whole lattice, whose log mass is 0
    starts: list[tuple | None] = [((), 1.0)] * n  # (forced edges, mass of the prefix), None: no segmentation is left
    results: list[list] = [[] for _ in range(n)]
    thresholds = np.full(n, -np.inf)
    for number in range(k + 1):
        if number:
            u = uniform(seed, number, keys, 2, 7)
            draw = uniform(seed, number, keys, 3, 7)
            branch = uniform(seed, number, keys, 4, 7)
            for d, queue in enumerate(queues):
                mass = queue.mass() if starts[d] is not None else 0.0
                if not mass > 0:
                    starts[d] = None
                    continue
                loc = math.log(mass)
                key[d] = loc - math.log(math.exp(min(700.0, loc - key[d])) - math.log(u[d]))
                if number == k:
                    thresholds[d] = key[d]
                    continue
                i, j = queue.pop(draw[d])
                (occs, steps, places, lengths), prefixes, others = queue.paths[i]
                o, step, prefix = int(occs[j]), int(steps[j]), float(prefixes[j])
                excluded = others.get(j, frozenset({int(lengths[j])}))
                options = [(e, p) for e, p in part.edges(o, int(places[j])) if e not in excluded]
                left = float(branch[d]) * sum(p for _, p in options)
                for e, p in options:
                    left -= p
                    if left <= 0:
                        break
                others[j] = excluded | {e}
                queue.masses[i][j] = prefix * max(0.0, sum(q for f, q in options if f != e))
                given = (np.append(occs[:j], o), np.append(steps[:j], step), np.append(lengths[:j], e))
                starts[d] = (given, prefix * p)
        if number == k:
            break
        given = [s[0] for s in starts if s and len(s[0])]
        path = part.sample(number, tuple(np.concatenate([np.zeros(0, np.int64), *(g[i] for g in given)]).astype(np.int64) for i in range(3)))
        occ, step, place, length, ids = path
        logp = np.bincount(part.doc[occ], part.edge_logp(ids), n) - part.log_sum
        doc, flat = part.spelt(path)
        ends = np.cumsum(np.bincount(doc, minlength=n))
        at = np.searchsorted(part.doc[occ], np.arange(n + 1))
        for d in range(n):
            if starts[d] is None:
                continue
            results[d].append((flat[(ends[d - 1] if d else 0) : ends[d]], logp[d], key[d]))
        for d, chances in _prefixes(part, path, at):
            if starts[d] is None:
                continue
            given, mass = starts[d]
            fixed = len(given[0]) if given else 0
            prefixes = np.zeros(len(chances))
            prefixes[fixed:] = mass * np.append(1.0, np.cumprod(chances[fixed:]))[: len(chances) - fixed]
            masses = prefixes * (1.0 - chances)
            masses[masses < 1e-15 * prefixes] = 0.0
            span = slice(at[d], at[d] + len(chances))
            queues[d].masses.append(masses)
            queues[d].paths.append(((occ[span], step[span], place[span], length[span]), prefixes, {}))
    for d in range(n):
        for rank, (ids, logp, g) in enumerate(results[d], 1):
            x = logp - thresholds[d]
            inclusion = 0.0 if x > 40 else (math.log(-math.expm1(-math.exp(x))) if x > -30 else x)
            yield d, rank, ids, float(logp), float(g), inclusion


def _prefixes(part: Slice, path: tuple[np.ndarray, ...], at: np.ndarray):
    """(document, probabilities of its path's first edges), as far as their product is at least LEAST_MASS."""
    occ, _, place, length, _ = path
    width = 128
    todo = np.arange(len(at) - 1)
    while len(todo):
        later = []
        spans = [np.arange(at[d], min(at[d] + width, at[d + 1])) for d in todo]
        where = np.concatenate(spans)
        chance = part.conditional(occ[where], place[where], length[where])
        ends = np.cumsum([len(s) for s in spans])
        for d, end, span in zip(todo, ends, spans, strict=True):
            mine = chance[end - len(span) : end]
            product = np.cumprod(mine)
            small = np.searchsorted(-product, -LEAST_MASS, side="right")
            if small >= len(mine) and at[d] + width < at[d + 1]:
                later.append(d)
            else:
                yield d, mine[: small + 1]
        todo, width = np.array(later, np.int64), width * 8


def sample_segmentations(docs: DataFrame, k: int = K, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """Up to k rows per row: id, rank (from 1), n_pieces, ids (binary, little-endian unsigned 16-bit), logp, gumbel,
    log_inclusion, and in the column ``decoded``, where it is named, the text that the ids decode to, as decode() gives it.
    Fewer where the lattice has fewer segmentations. No shuffle.

    Defined results: a null or empty text has one segmentation, without pieces, of log p 0. Rows that repeat an id
    share its random numbers, so equal rows give equal samples; a null id counts as key 0. Extra columns are ignored.
    """
    path = path or model_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        lat = lattices(path)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                doc_ids = piece.column("id")
                keys = np.array([x or 0 for x in doc_ids.to_pylist()], np.int64)
                found = list(top_k(lat, keys, [t or "" for t in piece.column("text").to_pylist()], k, seed))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([f[1] for f in found], pa.int32()),
                        pa.array([len(f[2]) for f in found], pa.int64()),
                        pa.array([f[2].astype("<u2").tobytes() for f in found], pa.binary()),
                        *(pa.array([f[i] for f in found], pa.float64()) for i in (3, 4, 5)),
                        *([pa.array(lat.decode_all([f[2] for f in found]), pa.string())] if decoded else []),
                    ],
                    names=[id_col, "rank", "n_pieces", "ids", "logp", "gumbel", "log_inclusion", *([decoded] if decoded else [])],
                )

    return map_arrow(rows, run, f"{id_col} long, rank int, n_pieces long, ids binary, logp double, gumbel double, log_inclusion double" + (f", {decoded} string" if decoded else ""))


def decode(samples: DataFrame, out: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``samples`` with a column ``out``, the text of the ids (binary, little-endian unsigned 16-bit); null for null ids."""
    path = path or model_path()
    rows = samples.select(*samples.columns, F.col(ids_col).alias("_ids"))
    names = samples.columns

    def run(batches):
        lat = store(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            for piece in slices(batch, "_ids", SLICE_BYTES):
                rows = piece.column("_ids").to_pylist()
                found = iter(lat.decode_all([np.frombuffer(x, "<u2") for x in rows if x is not None]))
                texts = [None if x is None else next(found) for x in rows]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, out])

    return map_arrow(rows, run, StructType([*rows.schema.fields[:-1], StructField(out, StringType())]))


def query(spark, sf_dir):
    """The samples, decoded again; of the decoded text its crc32 (UTF-8)."""
    samples = sample_segmentations(table(spark, sf_dir, "documents"), decoded="_text")
    return samples.withColumn("text_crc32", F.crc32(F.col("_text").cast("binary"))).drop("_text")


SQL = None
