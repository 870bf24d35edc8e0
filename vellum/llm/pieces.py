"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by A-star search over the lattice.

A text's lattice has a node before each character and an edge for each piece of
the vocabulary. Spaces become the mark of the vocabulary, a mark is put first, and
no edge crosses the start of a run of marks, so the lattice is a chain of the
lattices of chunks (marks and what follows them). A file of the BPE kind has
ranks for scores; an edge's weight is the Zipf probability of its piece's rank,
and a character that no piece holds is spelled in byte pieces. Backward sums give
each edge its probability given its node, so a walk draws a segmentation from the
lattice's distribution.

The search is top-down. The root has a Gumbel number; a node's best child keeps
its number, and the rest of its children, as one set, get one that is Gumbel by
their joint weight but cut off at it. The queue's best set is split next: its best
segmentation is given, the rest goes back. So the first k are the k largest
perturbed segmentations of all, distinct and in order, and the number then best
in the queue is the bound that turns weights into inclusion probabilities,
1 - exp(-exp(log_prob - bound)).

Random numbers are hashes of seed, row key, sample and character, so any task, in
any order, draws the same. Sums are taken within a document, so what is drawn
with it changes nothing.

The vocabulary file is read by the workers: it has to lie at the path given on
every executor, as a part of their image or put there by ``SparkContext.addFile``.

Defined results: a null text counts as empty; an empty text has one segmentation,
of no pieces, with inclusion 1; a text with fewer segmentations than k gives all
of them, with inclusion 1; a null key hashes as 0; repeated rows give equal
samples; a text that holds the mark itself decodes with spaces in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.hash_table import HashTable
from vellum.llm.rows import at_task_end, map_texts, picked

#: Segmentations of each text; seed; nodes after which a worker forgets the rarer chunks it has laid out.
SAMPLES, SEED, MOST_NODES = 2, 8, 500_000
#: Zipf: weight of rank r is 1 / (r + SHIFT); log probability of a byte piece.
SHIFT, BYTE_LOG = 10.0, -14.0
#: Bytes of texts worked on at once.
SLICE_BYTES = 768 << 10
#: Log probability of a prefix below which sets are drawn only if they could win, and the most that chance adds: a number
#: of 53 bits has a Gumbel under 37.
DEEP, MOST_NOISE = -80.0, 37.0
MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_K1 = np.uint64(0x9E3779B97F4A7C15)
ALPHABET = 1 << 21  # more than there are code points


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Samples of a text at most: above, the streams of samples would meet those of the walks.
MOST_SAMPLES = 256


def _uniform(keys: np.ndarray, at: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) hashed from mixed row keys, character places and a stream under 4096."""
    h = _mix(keys + (at.astype(np.uint64) * np.uint64(4096) + np.uint64(stream)) * _K1)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... count[k] of them, for one k after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Vocabulary:
    """Pieces of a SentencePiece file: their prefixes as numbered states, log weights, and spellings."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.byte_of = np.full(n, -1, np.int32)
        self.byte_id = np.zeros(256, np.int32)
        spelled: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_id[b], self.byte_of[i] = i, b
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                spelled[sp.id_to_piece(i)] = i
        ranks = np.arange(1, len(spelled) + 1)
        log = -np.log(ranks + SHIFT)
        log -= np.log(np.exp(log).sum())
        self.log = np.full(n, BYTE_LOG)
        self.log[np.array(sorted(spelled.values()), np.int64)] = log
        own = {v: k for k, v in spelled.items()}
        self.text = [own[i].replace(MARK, " ").encode() if i in own else (bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else b"") for i in range(n)]
        codes = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes, ids = np.array([len(x) for x in spelled], np.int64), np.array(list(spelled.values()), np.int32)
        at = np.cumsum(sizes) - sizes
        # a state is a prefix of pieces; state and next character lead to the next one; -1 where it is no piece itself
        state, keys, pieces, states = np.full(len(ids), -1, np.int64), [], [], 0
        for k in range(int(sizes.max(initial=0))):
            alive = sizes > k
            at, sizes, ids, state = at[alive], sizes[alive], ids[alive], state[alive]
            new, place = np.unique((state + 1) * ALPHABET + codes[at + k], return_inverse=True)
            state = place + states
            piece = np.full(len(new), -1, np.int32)
            piece[place[sizes == k + 1]] = ids[sizes == k + 1]
            keys.append(new), pieces.append(piece)
            states += len(new)
        self.piece = np.concatenate(pieces)
        self.steps = HashTable(np.concatenate(keys).astype(np.uint64))
        self.roots = np.full(int(codes.max(initial=0)) + 2, -1, np.int64)  # the last stands for all characters beyond
        self.roots[keys[0]] = np.arange(len(keys[0]))

        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.lengths = np.array([len(x) for x in self.text], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def spelled(self, ids: np.ndarray, start: np.ndarray) -> list[bytes]:
        """The bytes of many segmentations, ids[start[k]:start[k + 1]] each, without their first mark."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        data = self.bytes[_spread(self.offsets[ids], sizes)].tobytes()
        bound = np.concatenate([[0], ends])[start].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(bound, bound[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; byte pieces that are no UTF-8 give the replacement character."""
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if out.startswith(b" ") else out).decode(errors="replace")


class _Numbers(dict):
    """Chunks numbered as they come; ``new`` holds those without a lattice yet."""

    def __init__(self, chunks: list[str]) -> None:
        super().__init__(zip(chunks, range(len(chunks))))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


class Lattices:
    """Chunks laid out as lattices: nodes in one row of arrays, the edges of a node side by side, longest first.

    A node's edges have ``cut``, the probability of an edge and those before it,
    and ``chance``, its own. An unknown character's edge has the piece -1 - c for
    its code point c. A chunk's lattice depends on the chunk alone, not on those
    laid out with it. Past :data:`MOST_NODES` nodes the chunks met most often stay,
    up to half of them.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.numbers = _Numbers([])
        self.starts, self.hits = np.empty(0, np.int64), np.empty(0, np.int64)  # of each numbered chunk
        self.nodes, self.edges = 0, 1  # edge 0 is of no node, so that each edge has one before it
        room = 1 << 14
        # a node's first edge; its chunk's last node + 1
        self.first, self.end = np.ones(room + 1, np.int64), np.empty(room, np.int64)
        self.piece, self.size = np.empty(4 * room, np.int32), np.empty(4 * room, np.int16)
        self.cut, self.chance = np.empty(4 * room), np.empty(4 * room)
        self.cut[0] = 2.0

    def _room(self, nodes: int, edges: int) -> None:
        for names, need in ((("first", "end"), self.nodes + nodes + 1), (("piece", "size", "cut", "chance"), self.edges + edges)):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    new = np.empty(max(need, len(old) * 3 // 2), old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)

    def _forget(self) -> None:
        """Keep the chunks met most often, half of MOST_NODES nodes at most."""
        many = self.end[self.starts] - self.starts
        order = np.argsort(-self.hits, kind="stable")
        order = order[np.cumsum(many[order]) <= MOST_NODES // 2]
        order = np.sort(order[self.hits[order] > 1])
        chunks = list(self.numbers)
        self.numbers = _Numbers([chunks[k] for k in order.tolist()])
        start, many = self.starts[order], many[order]
        node = _spread(start, many)
        count = self.first[node + 1] - self.first[node]
        edge = _spread(self.first[node], count)
        self.starts, self.hits = np.cumsum(many) - many, self.hits[order] // 2
        self.nodes, self.edges = len(node), 1 + len(edge)
        self.end = np.append(np.repeat(self.starts + many, many), 0)
        self.first = np.concatenate([[1], 1 + np.cumsum(count)])
        for name in ("piece", "size", "cut", "chance"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old[:1], old[edge]]))

    def _edges(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edges of each node, piece, size, log weight), nodes in order."""
        v, n = self.v, len(code)
        state = v.roots[np.minimum(code, len(v.roots) - 1)]
        at = np.flatnonzero(state >= 0)
        state, length = state[at], 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.zeros(n, bool)
        while len(at):
            piece = v.piece[state]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], piece[whole]))
            if length == 1:
                known[at[whole]] = True
            inside = np.flatnonzero(left[at] > length)
            at = at[inside]
            state = v.steps.get(((state[inside] + 1) * ALPHABET + code[at + length]).astype(np.uint64))
            on = np.flatnonzero(state >= 0)
            at, state = at[on], state[on].astype(np.int64)
            length += 1
        lost = np.flatnonzero(~known)
        counts = (~known).astype(np.int64)
        for f, _ in found:
            counts[f] += 1
        first = np.cumsum(counts) - counts
        total = int(counts.sum())
        piece, size = np.empty(total, np.int32), np.ones(total, np.int16)
        free = first.copy()
        for k in range(len(found) - 1, -1, -1):
            f, p = found[k]
            where = free[f]
            piece[where], size[where] = p, k + 1
            free[f] += 1
        where = free[lost]
        piece[where] = -1
        log = v.log[piece]
        if len(lost):
            c = code[lost]
            piece[where] = (-1 - c).astype(np.int32)
            log[where] = BYTE_LOG * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        return counts, piece, size, log

    def add(self, chunks: list[str]) -> None:
        """Lay out ``chunks``, none of which is there yet; they come without their first mark."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        code = np.frombuffer((MARK + MARK.join(chunks)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, base = len(code), self.nodes
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        left = end - np.arange(n)
        counts, piece, size, log = self._edges(code, left)
        first = np.concatenate([[0], np.cumsum(counts)])
        total = int(first[-1])
        # backward sums, for all chunks at once, from their ends; in that order edges stand side by side too
        order = np.argsort(left.astype(np.uint16) if int(left.max(initial=0)) < 1 << 16 else left, kind="stable")
        m = counts[order]
        edge = _spread(first[order], m)
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        lead = np.concatenate([[0], np.cumsum(m)])
        target = np.repeat(order, m)
        target += size[edge]
        target[size[edge] == np.repeat(left[order], m)] = n  # the end of the chunk
        value, back, share = log[edge], np.zeros(n + 1), np.empty(total)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            here = slice(int(lead[a]), int(lead[b]))
            starts, many = lead[a:b] - lead[a], m[a:b]
            v = value[here] + back[target[here]]
            top = np.maximum.reduceat(v, starts)
            v -= np.repeat(top, many)
            np.exp(v, out=v)
            sums = np.add.reduceat(v, starts)
            back[order[a:b]] = top + np.log(sums)
            v /= np.repeat(sums, many)
            share[here] = v
        chance = np.empty(total)
        chance[edge] = share
        cut, at, stop = chance.copy(), first[:-1] + 1, first[1:]
        while len(at):
            more = np.flatnonzero(at < stop)
            at, stop = at[more], stop[more]
            cut[at] += cut[at - 1]
            at += 1
        cut[first[1:] - 1] = 2.0  # a number under 1 always finds an edge
        self._room(n, total)
        now = slice(self.edges, self.edges + total)
        self.piece[now], self.size[now], self.cut[now], self.chance[now] = piece, size, cut, chance
        self.first[base : base + n + 1] = first + self.edges
        self.end[base : base + n] = end + base
        self.nodes, self.edges = base + n, self.edges + total
        self.starts = np.concatenate([self.starts, ends - sizes + base])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), np.int64)])

    def nodes_of(self, chunks: list[str]) -> np.ndarray:
        """The first node of each chunk, laying out those that are new."""
        if self.nodes > MOST_NODES:
            self._forget()
        found = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        if self.numbers.new:
            self.add(self.numbers.new)
            self.numbers.new = []
        self.hits += np.bincount(found, minlength=len(self.hits))
        return self.starts[found]


def chunks_of(text: str) -> list[str]:
    """Runs of marks, each with what follows it, without its first mark; the text's first chunk has a mark before it too."""
    if not text:
        return []
    parts = (text.replace(MARK, " ") if MARK in text else text).split(" ")
    if "" not in parts:
        return parts
    out, marks = [], 0
    for p in parts:
        if p:
            out.append(MARK * marks + p)
            marks = 0
        else:
            marks += 1
    return out + ([MARK * (marks - 1)] if marks else [])


class Walks:
    """Segmentations drawn for chunks: edges in order, with the document and the character that each starts at."""

    def __init__(self, lattices: Lattices, doc: np.ndarray, node: np.ndarray, char: np.ndarray, keys: np.ndarray, stream: int) -> None:
        """``doc``, ``node``, ``char``: of each chunk, its document, the node to start at and that node's character."""
        t, cur, live = lattices, node.copy(), np.arange(len(node))
        key, ahead, end = keys[doc], char - node, t.end[node]
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = np.zeros(len(node), np.int64)
        while len(live):
            here = cur[live]
            place = here + ahead[live]
            u = _uniform(key[live], place, 2 * stream)
            e = t.first[here]
            more = np.flatnonzero(u >= t.cut[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= t.cut[e[more]]]
            steps.append((live, e, place))
            count[live] += 1
            here += t.size[e]
            cur[live] = here
            live = live[here < end[live]]
        at = np.cumsum(count) - count
        total = int(count.sum())
        self.edge, self.char = np.empty(total, np.int64), np.empty(total, np.int64)
        for k, (live, e, place) in enumerate(steps):
            where = at[live] + k
            self.edge[where], self.char[where] = e, place
        self.doc = np.repeat(doc, count)


class _Held:
    """A sample drawn for many documents, with the numbers of the sets beside its edges."""

    def __init__(self, t: Lattices, keys: np.ndarray, edge: np.ndarray, char: np.ndarray, doc: np.ndarray, first_of: np.ndarray, top: np.ndarray, number: int) -> None:
        """``first_of``: of each document the character from which this sample's sets are its own."""
        self.t, self.keys, self.edge, self.char, self.doc, self.top, self.number = t, keys, edge, char, doc, top, number
        docs = len(keys)
        self.start = np.searchsorted(doc, np.arange(docs + 1))
        self.chance = t.chance[edge]
        logs = np.log(self.chance)
        self.prefix, self.total = np.zeros(len(edge)), np.zeros(docs)
        bounds = self.start.tolist()
        for d, (a, b) in enumerate(zip(bounds, bounds[1:])):  # a document at a time, so that its sums don't depend on the others
            if b > a:
                np.cumsum(logs[a : b - 1], out=self.prefix[a + 1 : b])
                self.total[d] = self.prefix[b - 1] + logs[b - 1]
        self.queue = np.full(len(edge), -np.inf)
        self.gone = np.empty(0, np.int64)  # places and edges that were split off them
        own = char >= first_of[doc]
        # what a sample shares with the one it left is in that one's queue; deeper sets wait until they could win
        self.deep = np.flatnonzero(own & (self.prefix < DEEP))
        self._draw(np.flatnonzero(own & (self.prefix >= DEEP)))

    def _draw(self, at: np.ndarray) -> None:
        """Numbers of the sets beside the edges ``at``: Gumbel by their weight, cut off at their document's ``top``."""
        e, t = self.edge[at], self.t
        at = at[(t.cut[e] <= 1) | (t.cut[e - 1] <= 1)]  # not the only edge of its node
        rest = np.log(np.maximum(1 - self.chance[at], 1e-18)) + self.prefix[at]
        noise = -np.log(_uniform(self.keys[self.doc[at]], self.char[at], 2 * (self.number + 2) + 1))
        self.queue[at] = rest - np.log(np.exp(np.minimum(rest - self.top[self.doc[at]], 700)) + noise)

    def draw_deep(self) -> None:
        at, self.deep = self.deep, self.deep[:0]
        self._draw(at)

    def split(self, best: np.ndarray, mine: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes sample ``number`` from the best set of each document in ``mine``: (document, place, node, new edge). The rest of the set goes back."""
        t = self.t
        at = np.flatnonzero(mine[self.doc] & (self.queue == best[self.doc]))
        at = at[np.concatenate([[True], self.doc[at[1:]] != self.doc[at[:-1]]])]  # ties: the first
        d = self.doc[at]
        node = np.searchsorted(t.first[: t.nodes + 1], self.edge[at], "right") - 1
        first, many = t.first[node], t.first[node + 1] - t.first[node]
        column = np.arange(int(many.max()))
        edges = np.where(column < many[:, None], first[:, None] + column, 0)
        left = (edges > 0) & (edges != self.edge[at][:, None]) & ~np.isin(at[:, None] * t.edges + edges, self.gone)
        chance = np.where(left, t.chance[edges], 0.0)
        run = np.cumsum(chance, axis=1)
        u = _uniform(self.keys[d], self.char[at], 1000 + 4 * number) * run[:, -1]
        last = len(column) - 1 - left[:, ::-1].argmax(axis=1)
        pick = np.minimum((left & (run > u[:, None])).argmax(axis=1) + np.where(run[:, -1] > u, 0, len(column)), last)
        rows = np.arange(len(at))
        edge = edges[rows, pick]
        chance[rows, pick] = 0.0
        self.gone = np.append(self.gone, at * t.edges + edge)
        rest = self.prefix[at] + np.log(np.maximum(chance.sum(axis=1), 1e-300))
        noise = -np.log(_uniform(self.keys[d], self.char[at], 1002 + 4 * number))
        self.queue[at] = np.where(left.sum(axis=1) > 1, rest - np.log(np.exp(np.minimum(rest - best[d], 700)) + noise), -np.inf)
        return d, at, node, edge


def _best(held: list[_Held], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest number in the queues of each document, and the sample whose queue has it."""
    best, owner = np.full(docs, -np.inf), np.full(docs, -1, np.int64)
    for p, h in enumerate(held):
        has = np.flatnonzero(h.start[1:] > h.start[:-1])
        if len(has):
            most = np.maximum.reduceat(h.queue, h.start[has])
            better = most > best[has]
            best[has[better]] = most[better]
            owner[has[better]] = p
    return best, owner


def sample(lattices: Lattices, keys: np.ndarray, texts: list[str], k: int) -> list[tuple]:
    """Per sample number: (documents, starts, piece edges, log_prob, perturbed) and, last, each document's bound.

    Documents are places in ``texts``; bound is minus infinity where no segmentation is left.
    """
    t, docs = lattices, len(texts)
    chunks = [chunks_of(x) for x in texts]
    many = np.fromiter(map(len, chunks), np.int64, docs)
    node = t.nodes_of([c for d in chunks for c in d])
    sizes = t.end[node] - node
    chunk_ends = np.cumsum(many)
    of = np.repeat(np.arange(docs), many)
    start = np.cumsum(sizes) - sizes  # the first character of each chunk, counted over all texts
    base = np.append(start, 0)[chunk_ends - many]
    char = start - base[of]
    top = -np.log(-np.log(_uniform(keys, np.zeros(docs, np.int64), 1)))
    out: list[tuple] = []
    alive, first_of, held = np.arange(docs), np.zeros(docs, np.int64), []
    walk = Walks(t, of, node, char, keys, 2)
    edge, place, doc = walk.edge, walk.char, walk.doc
    bound = np.full(docs, -np.inf)
    for number in range(k):
        now = _Held(t, keys, edge, place, doc, first_of, top, number)
        held.append(now)
        out.append((alive, now.start, edge, now.total, top))
        bound, owner = _best(held, docs)
        if any((bound[h.doc[h.deep]] < DEEP + MOST_NOISE).any() for h in held):
            for h in held:
                h.draw_deep()
            bound, owner = _best(held, docs)
        alive = np.flatnonzero(owner >= 0)
        if number + 1 == k or not len(alive):
            break
        # from each document's best set: the edges before its place, the new edge, and a walk from there
        top, first_of = bound.copy(), np.zeros(docs, np.int64)
        heads, lengths = [], np.zeros(docs, np.int64)
        at_node, at_char = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for p in np.unique(owner[alive]).tolist():
            h = held[p]
            d, at, where, new = h.split(bound, owner == p, number)
            lengths[d] = at - h.start[d] + 1
            first_of[d] = h.char[at] + 1
            at_node[d], at_char[d] = where + t.size[new], h.char[at] + t.size[new]
            whole = _spread(h.start[d], lengths[d])
            before, chars = h.edge[whole], h.char[whole]
            before[np.cumsum(lengths[d]) - 1] = new
            heads.append((d, before, chars))
        chunk = np.searchsorted(start, base[alive] + first_of[alive] - 1, "right") - 1
        inside = at_char[alive] < char[chunk] + sizes[chunk]
        rest = chunk_ends[alive] - chunk - ~inside  # chunks left, the one begun included
        which = _spread(chunk + ~inside, rest)
        tail_node, tail_char = node[which], char[which]
        begun = (np.cumsum(rest) - rest)[inside]
        tail_node[begun], tail_char[begun] = at_node[alive[inside]], at_char[alive[inside]]
        walk = Walks(t, of[which], tail_node, tail_char, keys, number + 3)
        tails = np.bincount(walk.doc, minlength=docs)
        first = np.cumsum(lengths + tails) - lengths - tails
        total = int(lengths.sum() + tails.sum())
        edge, place, doc = np.empty(total, np.int64), np.empty(total, np.int64), np.repeat(np.arange(docs), lengths + tails)
        for d, before, chars in [*heads, (np.arange(docs), walk.edge, walk.char)]:
            to = _spread(first[d], lengths[d]) if before is not walk.edge else _spread(first + lengths, tails)
            edge[to], place[to] = before, chars
    return [*out, bound]


_vocabularies: dict[str, Vocabulary] = {}
_loaded: dict[str, Lattices] = {}
at_task_end(_loaded.clear)  # the vocabulary stays, the chunks laid out go


def _lattices(path: str) -> Lattices:
    if path not in _loaded:
        if path not in _vocabularies:
            _vocabularies[path] = Vocabulary(path)
        _loaded[path] = Lattices(_vocabularies[path])
    return _loaded[path]


SCHEMA = "doc_id bigint, sample int, n_pieces int, piece_ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded boolean"


def _ids(t: Lattices, edges: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, starts), the characters that no piece holds spelled in byte pieces."""
    piece = t.piece[edges]
    if len(piece) and piece.min() < 0:
        lost, which = np.unique(piece[piece < 0], return_inverse=True)
        spelled = [t.v.byte_id[list(chr(-1 - p).encode("utf-8", "surrogatepass"))] for p in lost.tolist()]
        sizes = np.array([len(x) for x in spelled])
        many = np.ones(len(piece), np.int64)
        many[piece < 0] = sizes[which]
        out = np.repeat(piece, many)
        out[np.repeat(piece < 0, many)] = np.concatenate(spelled)[_spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return out, np.concatenate([[0], np.cumsum(many)])[start]
    return piece, start


def segment(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k segmentations of each text: doc_id, sample (from 0), n_pieces, piece_ids, log_prob, perturbed, log_inclusion, decoded.

    decoded says whether the pieces decode to the text. ``k`` may be MOST_SAMPLES at most, as each sample draws from random streams of its own.
    """
    if not 0 <= k <= MOST_SAMPLES:
        raise ValueError(f"k is from 0 to {MOST_SAMPLES}, not {k}")

    def each(ids: list, raw: list[bytes]) -> dict[str, object]:
        t = _lattices(model)
        texts = [x.decode() for x in raw]
        keys = _mix(np.array([0 if i is None else i & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64) + np.uint64(seed * int(_K1) & 0xFFFFFFFFFFFFFFFF))
        *samples, bound = sample(t, keys, texts, k)
        doc_id, number, n, lists, log_prob, perturbed, log_inclusion, decoded = [], [], [], [], [], [], [], []
        for s, (alive, start, edges, total, top) in enumerate(samples):
            values, at = _ids(t, edges, start)
            where = at[alive]
            sizes = at[alive + 1] - where
            doc_id += [ids[d] for d in alive.tolist()]
            number.append(np.full(len(alive), s, np.int32))
            n.append(sizes)
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32())))
            lp = total[alive]
            log_prob.append(lp), perturbed.append(top[alive])
            gap = np.exp(np.minimum(lp - bound[alive], 700.0))
            log_inclusion.append(np.where(bound[alive] == -np.inf, 0.0, np.log(np.maximum(-np.expm1(-gap), 1e-300))))
            tiny = (gap < 1e-12) & (bound[alive] > -np.inf)
            log_inclusion[-1][tiny] = (lp - bound[alive])[tiny]
            bodies = t.v.spelled(values, at)
            decoded += [bodies[d] == raw[d] for d in alive.tolist()]
        return {
            "doc_id": doc_id, "sample": np.concatenate(number), "n_pieces": np.concatenate(n), "piece_ids": pa.concat_arrays(lists),
            "log_prob": np.concatenate(log_prob), "perturbed": np.concatenate(perturbed), "log_inclusion": np.concatenate(log_inclusion), "decoded": decoded,
        }

    return map_texts(picked(docs, id_col, text_col), SCHEMA, each, slice_bytes=SLICE_BYTES)


def decode(rows: DataFrame, ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and ``decoded_text``, the text that its pieces spell; null pieces give null."""
    @F.pandas_udf("string")
    def spell(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _lattices(model).v
        for batch in ids:
            yield batch.map(lambda x: None if x is None else v.decode(x.tolist()))

    return rows.withColumn("decoded_text", spell(ids_col))
