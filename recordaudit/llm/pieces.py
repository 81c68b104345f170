"""SentencePiece encoding and decoding by a max-plus parallel scan.

A path through the text's pieces scores 0 for every pair of neighbours that fits and
minus infinity for one that does not.  Two pieces fit if merging their joint text in
the model's order leaves exactly these two; the encoding of a text is the only path
all of whose neighbours fit, so the path of score 0 is the library's own result
(``tests/llm`` hold it against the sentencepiece library).  For each prefix of a text
there is one such path, so a word is solved from left to right with one piece per
place, all words of a batch at once.

No piece spans a place before a run of U+2581 signs that follows another character
(checked on the vocabulary), so the words between such places are solved once each
while a task remembers them (``SOLVED_BYTES``).  Giant documents (over ``CHUNK`` characters) are cut into chunks that are
dealt over the cluster.  A chunk yields its transfer matrix from the states at its left
border to those at its right border (state: the piece that meets or spans the border);
of the matrix only the zeros are kept, as pairs of states.  The matrices of ``SPAN`` chunks
are combined under (max, +), which is associative, in a task each; the products give
the states between the spans, then every span those between its chunks, and every chunk
is backtraced in its own task.  Copies of a giant text are encoded once.

Defined cases: null and empty texts have no pieces (and decode to the empty text); text
that holds U+2581 itself decodes to a space there, as in the library, and shows
``round_trip`` false; characters outside the vocabulary fall back to their bytes;
repeated rows are each encoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import materialize, mix, plain_names, slices, span_hashes, table, trim_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 32_768  # characters of a chunk of a giant document
SPAN = 256  # chunks whose matrices one task combines
ROWS_BY_WIDTH = 200_000  # characters of words that are solved at a time
SOLVED_BYTES = 24 << 20  # pieces of words that a task remembers
SLICE = 2 << 20  # bytes of texts that are encoded at a time
NEVER = 1 << 40
START = -1  # the state before the first piece


# --- model file ------------------------------------------------------------

def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at:at + n]
            at += n


def read_model(spark, path: str = MODEL) -> dict:
    """Pieces of a model file (read through Spark) with the merge tables that are derived from them once."""
    raw = bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])
    pieces, norm, kind = [], {3: 1, 4: 1, 5: 1}, 1
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            norm |= dict(_fields(value))
    if kind != 2 or norm.get(2) or norm[4] or not norm[5]:
        raise ValueError("only BPE models without a character map that keep all white space are supported")
    return {"pieces": pieces, "prefix": bool(norm[3])} | merge_tables(pieces)


def merge_tables(pieces: list[tuple[str, float, int]]) -> dict:
    """rank (-1: single character), last merge (left, right) and the mergeable pairs of all pieces.

    Pieces that merging their own text does not give back are left out (rank NEVER)."""
    normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
    order = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-pieces[i][1], i))
    rank = np.full(len(pieces) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    left, right = np.zeros(len(pieces) + 1, np.int32), np.zeros(len(pieces) + 1, np.int32)
    pairs, merged = [], []
    for i in order:
        p = pieces[i][0]
        for c in range(1, len(p)):
            if p[:c] in normal and p[c:] in normal:
                pairs.append(normal[p[:c]] * (len(pieces) + 1) + normal[p[c:]])
                merged.append(i)
        parts = list(p)
        while len(parts) > 1:
            best = min(((rank[normal[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                        if a + b in normal), default=None)
            if best is None:
                break
            k = best[1]
            if len(parts) == 2:
                left[i], right[i] = normal.get(parts[0], len(pieces)), normal.get(parts[1], len(pieces))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) > 1:
            rank[i] = NEVER
    by = np.argsort(pairs, kind="stable")
    return {"rank": rank, "left": left, "right": right, "pairs": np.array(pairs, np.int64)[by],
            "merged": np.array(merged, np.int32)[by]}


class Solved:
    """The pieces of words that were solved before, by the words' hashes; starts anew beyond SOLVED_BYTES.

    The pieces lie in the order they were solved in, those of word k are ids[begin[k]:begin[k] + count[k]]."""

    def __init__(self):
        self.h, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, vocab: Vocabulary, h: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the words of the (sorted, distinct) hashes ``h`` are; those not known yet are solved."""
        if self.h.nbytes + self.begin.nbytes + self.count.nbytes + self.ids.nbytes > SOLVED_BYTES:
            self.__init__()
        new = np.ones(len(h), bool)
        if len(self.h):
            new = self.h[np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)] != h
        if new.any():
            ids, first = solve_words(vocab, cps, starts[new], ends[new])
            at = np.searchsorted(self.h, h[new])
            self.h = np.insert(self.h, at, h[new])
            self.begin = np.insert(self.begin, at, first[:-1] + len(self.ids))
            self.count = np.insert(self.count, at, np.diff(first))
            self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.h, h)


class Vocabulary:
    """Lookup tables of a model."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.prefix = model["prefix"]
        self.rank, self.left, self.right = model["rank"], model["left"], model["right"]
        self.pairs, self.merged = model["pairs"], model["merged"]
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == 6:
                b = int(piece[1:-1], 16)
                self.byte_ids[b] = i
                self.raw.append(bytes([b]))
            else:
                self.raw.append(piece.replace(SPACE, " ").encode() if kind == 1 else b"")
            if kind == 1 and self.rank[i] != NEVER:
                self.ids[piece] = i
        self.size = max(map(len, self.ids), default=1)
        self.unknown = len(pieces)
        self.words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.weights = mix(np.arange(1, self.size + 1, dtype=np.uint64)) | np.uint64(1)
        cps = [np.array([ord(c) for c in p], np.uint64) for p in self.ids]
        keys = np.array([((mix(c) * self.weights[:len(c)]).sum(dtype=np.uint64) ^ np.uint64(len(c))) for c in cps], np.uint64)
        keys = mix(keys)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.pair_filter = np.zeros(1 << 24, bool)
        self.pair_filter[(mix(self.pairs.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)] = True
        self.known: dict[int, bool] = {}
        self.solved = Solved()

    def matches(self, cps: np.ndarray) -> list[np.ndarray]:
        """For lengths 1, 2, ...: rows x starts of piece ids, -1 where none (length 1: unknown)."""
        mixed = mix(cps.astype(np.uint64))
        out, h = [], np.zeros(cps.shape, np.uint64)
        for n in range(1, min(self.size, cps.shape[1]) + 1):
            width = cps.shape[1] - n + 1
            h = h[:, :width] + mixed[:, n - 1:] * self.weights[n - 1]
            key = mix(h ^ np.uint64(n))
            ids = np.full(key.shape, self.unknown if n == 1 else -1, np.int32)
            r, c = np.nonzero(self.filter[(key >> np.uint64(42)).astype(np.int64)])
            k = key[r, c]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            ok = self.keys[at] == k
            ids[r[ok], c[ok]] = self.key_ids[at[ok]]
            out.append(ids)
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of neighbours a, b leaves exactly a and b.

        The merges are undone from the last one back: before a piece's own last merge, the
        parts at the border must not have been mergeable earlier (ties: the left one first)."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER)
        while len(at):
            key = a * (self.unknown + 1) + b
            merge = np.full(len(key), NEVER)
            maybe = np.flatnonzero(self.pair_filter[(mix(key.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.pairs, key[maybe]), len(self.pairs) - 1)
            hit = self.pairs[k] == key[maybe]
            merge[maybe[hit]] = self.rank[self.merged[k[hit]]]
            bad = merge < limit
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def fit(self, a: int, b: int) -> bool:
        key = a * (self.unknown + 1) + b
        if key not in self.known:
            self.known[key] = bool(self.fits(np.array([a]), np.array([b]))[0])
        return self.known[key]


# --- words -------------------------------------------------------------------

def _expand(vocab: Vocabulary, piece: int, cp: int) -> list[int]:
    if piece != vocab.unknown:
        return [piece]
    return [int(vocab.byte_ids[b]) for b in chr(cp).encode()]


def _solve(vocab: Vocabulary, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, piece) of the pieces of words (rows x width code points, padded), in order."""
    n, width = rows.shape
    ids = vocab.matches(rows)
    piece = np.full((n, width + 1), -1, np.int32)  # the last piece of the prefix
    back = np.zeros((n, width + 1), np.int32)
    for p in range(1, width + 1):
        open_rows = np.flatnonzero(size >= p)
        for k in range(min(len(ids), p), 0, -1):
            cand = ids[k - 1][open_rows, p - k]
            has = cand >= 0
            r, cand = open_rows[has], cand[has]
            if not len(r):
                continue
            ok = np.ones(len(r), bool) if p == k else vocab.fits(piece[r, p - k], cand)
            piece[r[ok], p] = cand[ok]
            back[r[ok], p] = k
            open_rows = open_rows[piece[open_rows, p] < 0]
        if len(open_rows):
            raise ValueError("a prefix has no encoding")
    row, at, found = np.arange(n), size.copy(), []
    while len(row):
        begin = at - back[row, at]
        found.append((row, begin, piece[row, at]))
        row, at = row[begin > 0], begin[begin > 0]
    r, b, i = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, r))
    return r[order], b[order], i[order]


def solve_words(vocab: Vocabulary, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of many separate words, solved in arrays of similar length."""
    size = ends - starts
    counts = np.zeros(len(starts), np.int64)
    word, place, flat = [], [], []
    lo_size = 0
    for hi_size in (6, 10, 16, 24, 40, 80, 1 << 60):
        members = np.flatnonzero((size > lo_size) & (size <= hi_size))
        lo_size = hi_size
        if hi_size == 1 << 60:  # long words one by one
            groups = [np.array([k]) for k in members]
        else:
            groups = [members[x:x + ROWS_BY_WIDTH // hi_size] for x in range(0, len(members), ROWS_BY_WIDTH // hi_size)]
        for part in groups:
            if len(part) == 1 and size[part[0]] > 80:
                k = part[0]
                got = walk(vocab, text_of(cps[starts[k]:ends[k]]), 0, None)
                path = trace(got, 0, int(size[k]))
                r, b = np.zeros(len(path), np.int64), np.array([x[0] for x in path])
                i = np.array([x[1] for x in path], np.int32)
            else:
                width = int(size[part].max())
                span = np.arange(width)
                inside = span[None, :] < size[part][:, None]
                rows = np.where(inside, cps[np.minimum(starts[part][:, None] + span, len(cps) - 1)], 0)
                r, b, i = _solve(vocab, rows, size[part])
            odd = i == vocab.unknown
            if odd.any():
                times = np.ones(len(i), np.int64)
                raw = [_expand(vocab, vocab.unknown, int(cps[starts[part[x]] + y])) for x, y in zip(r[odd], b[odd], strict=True)]
                times[odd] = [len(x) for x in raw]
                i = np.repeat(i, times)
                i[np.repeat(odd, times)] = np.concatenate([np.array(x, np.int32) for x in raw])
                r, b = np.repeat(r, times), np.repeat(b, times)
            word.append(part[r])
            flat.append(i)
    if not flat:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    w, f = np.concatenate(word), np.concatenate(flat)
    order = np.argsort(w, kind="stable")
    np.add.at(counts, w, 1)
    return f[order], np.concatenate([[0], np.cumsum(counts)])


def text_of(cps: np.ndarray) -> str:
    return cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_cuts(vocab: Vocabulary, cps: np.ndarray) -> np.ndarray:
    """Places that no piece spans (within one text)."""
    if not vocab.words or len(cps) < 2:
        return np.zeros(0, np.int64)
    space = cps == ord(SPACE)
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def encode_texts(vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of whole texts: ids of text i are first[i]:first[i + 1]."""
    prefix = SPACE if vocab.prefix else ""
    full = [prefix + t if t else "" for t in texts]
    cps = code_points("".join(full).replace(" ", SPACE))
    if not len(cps):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in full])])
    begins = np.zeros(len(cps), bool)
    begins[word_cuts(vocab, cps)] = True
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    out, total = span_ids(vocab, cps, starts, np.append(starts[1:], len(cps)))
    return out, total[np.searchsorted(starts, bounds)]


def span_ids(vocab: Vocabulary, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of words; equal words are solved once in a task (while they are remembered)."""
    h, sample, which = np.unique(span_hashes(cps, starts, ends), return_index=True, return_inverse=True)
    at = vocab.solved.find(vocab, h, cps, starts[sample], ends[sample])[which]
    begin, count = vocab.solved.begin[at], vocab.solved.count[at]
    total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    return vocab.solved.ids[np.repeat(begin - total[:-1], count) + np.arange(int(total[-1]))], total


def decode_ids(vocab: Vocabulary, ids) -> str:
    text = b"".join([vocab.raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if vocab.prefix and text.startswith(" ") else text


# --- chunks of giant documents ---------------------------------------------------
# A state at a border B is a piece from s < B to e >= B, written as (B - s) * 64 + (e - B).

def pieces_from(vocab: Vocabulary, text: str, s: int) -> list[tuple[int, int]]:
    """(end, id) of the pieces that start at ``s``; a character outside the vocabulary is one, too."""
    out = [(s + k, vocab.ids[text[s:s + k]]) for k in range(1, min(vocab.size, len(text) - s) + 1) if text[s:s + k] in vocab.ids]
    return out if out and out[0][0] == s + 1 else [(s + 1, vocab.unknown), *out]


def walk(vocab: Vocabulary, text: str, start: int, before: int | None, stop: int | None = None) -> dict[int, tuple[int, int]]:
    """place -> (start, id) of the last piece of the path of score 0 from ``start`` to that place,
    where there is one; ``before`` is the piece that ends at ``start``.  Pieces start before ``stop``."""
    stop = len(text) if stop is None else stop
    got: dict[int, tuple[int, int]] = {}
    for s in range(start, stop):
        if s > start and s not in got:
            continue
        last = before if s == start else got[s][1]
        for e, i in pieces_from(vocab, text, s):
            if last is None or vocab.fit(last, i):
                got[e] = (s, i)
    return got


def trace(got: dict[int, tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """(start, id) of the pieces of a walk from ``start`` to ``end``, in order."""
    out = []
    while end > start:
        s, i = got[end]
        out.append((s, i))
        end = s
    return out[::-1]


def exits(vocab: Vocabulary, text: str, got: dict, start: int, before: int | None, border: int, last: bool) -> list[int]:
    """States at ``border`` that the walk reaches."""
    out = []
    for s in range(max(start, border - vocab.size), border):
        if s == start or s in got:
            prev = before if s == start else got[s][1]
            for e, i in pieces_from(vocab, text, s):
                if e >= border and (not last or e == len(text)) and (prev is None or vocab.fit(prev, i)):
                    out.append((border - s) * 64 + e - border)
    return out


def entries(vocab: Vocabulary, text: str, border: int) -> list[tuple[int, int, int]]:
    """(state, end, id) of all pieces that meet or span ``border``."""
    return [((border - s) * 64 + e - border, e, i) for s in range(max(0, border - vocab.size), border)
            for e, i in pieces_from(vocab, text, s) if e >= border]


def chunk_matrix(vocab: Vocabulary, text: str, back: int, n: int, last: bool) -> list[tuple[int, int]]:
    """The zeros (state, state) of a chunk's transfer matrix.  ``text`` holds ``back`` characters
    before the chunk's ``n`` and the look-ahead after them; without ``back`` the chunk is the first."""
    border = back + n
    cuts = word_cuts(vocab, code_points(text))
    cuts = cuts[(cuts > back) & (cuts < border)].tolist()
    begins = entries(vocab, text, back) if back else [(START, 0, None)]
    if cuts:
        enter = [state for state, e, i in begins if e == cuts[0] or e < cuts[0] and cuts[0] in walk(vocab, text, e, i, cuts[0])]
        leave = exits(vocab, text, walk(vocab, text, cuts[-1], None, border), cuts[-1], None, border, last)
        return [(a, b) for a in enter for b in leave]
    out = []
    for state, e, i in begins:
        if e >= border and i is not None:  # the piece spans the chunk
            out.append((state, (border - e) * 64 + (state // 64 + state % 64) * 64 + e - border))
        else:
            out += [(state, x) for x in exits(vocab, text, walk(vocab, text, e, i, border), e, i, border, last)]
    return out


def combine(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (max, +) product of two matrices that are given by their zeros."""
    rows: dict[int, list[int]] = {}
    for x, y in b:
        rows.setdefault(x, []).append(y)
    return list({(x, z) for x, y in a for z in rows.get(y, ())})


def product(matrices: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The (max, +) product of matrices in a row, pair by pair (it is associative)."""
    while len(matrices) > 1:
        odd = matrices[len(matrices) & ~1:]
        matrices = [combine(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)] + odd
    return matrices[0]


def border_states(matrices: list[list[tuple[int, int]]], entry: int = START, exit: int | None = None) -> list[int]:
    """The states at all borders of the path of score 0 from ``entry`` through the chunks (to ``exit``)."""
    prefix = [[(entry, entry)]]
    for m in matrices:
        prefix.append(combine(prefix[-1], m))
    (state,) = {y for _, y in prefix[-1]} if exit is None else {exit}
    out = [state]
    for before, m in zip(prefix[-2::-1], matrices[::-1], strict=True):
        reached = {y for _, y in before}
        (state,) = {x for x, y in m if y == out[-1] and x in reached}
        out.append(state)
    return out[::-1]


def chunk_parts(vocab: Vocabulary, text: str, back: int, n: int, entry: int, exit: int) -> tuple[list, np.ndarray, np.ndarray, list]:
    """Between its border states, the pieces that start in a chunk: ids up to the first word cut, the
    code points and the cuts of the words in between, ids from the last cut on."""
    border = back + n
    start, before = back, None
    none = np.zeros(0, np.int64)
    if entry != START:
        start = back + entry % 64
        piece = text[back - entry // 64:start]
        before = vocab.ids.get(piece, vocab.unknown)
    last_start = border - exit // 64
    cps = code_points(text)
    if start > last_start:
        return [], cps, none, []
    last_piece = (last_start, vocab.ids.get(text[last_start:border + exit % 64], vocab.unknown))
    cuts = word_cuts(vocab, cps)
    cuts = cuts[(cuts >= start) & (cuts <= last_start) & (cuts > back)]

    def ids(path):
        return [y for s, i in path for y in _expand(vocab, i, int(cps[s]))]

    if not len(cuts):
        return ids([*trace(walk(vocab, text, start, before, last_start), start, last_start), last_piece]), cps, none, []
    a, b = int(cuts[0]), int(cuts[-1])
    head = trace(walk(vocab, text, start, before, a), start, a)
    tail = [*trace(walk(vocab, text, b, None, last_start), b, last_start), last_piece]
    return ids(head), cps, cuts, ids(tail)


def chunks_ids(vocab: Vocabulary, chunks: list[tuple]) -> list[list[int]]:
    """Ids of many chunks (text, back, n, entry, exit): the words of all of them are solved together."""
    parts = [chunk_parts(vocab, *c) for c in chunks]
    shift = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
    cps = np.concatenate([p[1] for p in parts])
    starts = np.concatenate([p[2][:-1] + s for p, s in zip(parts, shift, strict=False)]).astype(np.int64)
    ends = np.concatenate([p[2][1:] + s for p, s in zip(parts, shift, strict=False)]).astype(np.int64)
    ids, first = span_ids(vocab, cps, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    at = np.concatenate([[0], np.cumsum([max(len(p[2]) - 1, 0) for p in parts])])
    return [[*p[0], *ids[first[at[k]]:first[at[k + 1]]].tolist(), *p[3]] for k, p in enumerate(parts)]


def encode(docs: DataFrame, model: dict, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """``columns`` of every row plus ``ids`` (array), ``n_pieces`` and ``round_trip`` (decoding gives the text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    size = max((len(p) for p, _, kind in model["pieces"] if kind == 1), default=1)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"))
    giant = F.coalesce(F.char_length("_text") > chunk, F.lit(False))
    schema = docs.select(*columns).schema.add("ids", ArrayType(IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for big in batches:
            for batch in slices(big, "_text", SLICE):
                yield whole_slice(vocab, batch)
                trim_memory()

    def whole_slice(vocab: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        """A slice's rows; what it takes besides them is free again when they are handed on."""
        texts = batch.column("_text").to_pylist()
        ids, first = encode_texts(vocab, texts)
        same = [decode_ids(vocab, ids[first[k]:first[k + 1]].tolist()) == (t or "") for k, t in enumerate(texts)]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in columns],
             pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())),
             pa.array(np.diff(first)), pa.array(same)], names=[*columns, "ids", "n_pieces", "round_trip"])

    plain = rows.where(~giant).mapInArrow(whole, schema)

    # giant texts: chunks -> matrices -> products of SPAN chunks -> border states -> chunks backtraced
    key = F.sha2(F.encode("_text", "UTF-8"), 256)
    prefix = SPACE if model["prefix"] else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "c", "back", "n", "last", "part"]
        for big in batches:
            for k, text in zip(*[c.to_pylist() for c in big.columns], strict=True):
                t = prefix + text.replace(" ", SPACE)
                for lo in range(0, len(t), 64 * chunk):
                    rows = [(k, x // chunk, size if x else 0, min(chunk, len(t) - x), x + chunk >= len(t), t[max(x - size, 0):x + chunk + size])
                            for x in range(lo, min(lo + 64 * chunk, len(t)), chunk)]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], chunk_type)

    chunk_type = pa.schema([("key", pa.string()), ("c", pa.int32()), ("back", pa.int32()), ("n", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])
    chunks = rows.where(giant).select(key.alias("key"), "_text") \
        .mapInArrow(cut, "key string, c int, back int, n int, last boolean, part string")
    chunks = materialize(chunks.dropDuplicates(["key", "c"]), "piece-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for big in batches:
            for b in slices(big, "part", 1 << 20):
                zeros = [chunk_matrix(vocab, *x) for x in zip(*[b.column(c).to_pylist() for c in ("part", "back", "n", "last")], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("c"), pa.array([[x for pair in z for x in pair] for z in zeros], pa.list_(pa.int32()))],
                    names=["key", "c", "m"])
                trim_memory()

    def zeros(column) -> list[list[tuple[int, int]]]:
        return [list(zip(m[::2], m[1::2], strict=True)) for m in column.to_pylist()]

    def spans(t: pa.Table) -> pa.Table:
        whole = product(zeros(t.sort_by("c").column("m")))
        return pa.table({"key": t.column("key")[:1], "b": t.column("b")[:1], "m": pa.array([[x for pair in whole for x in pair]], pa.list_(pa.int32()))})

    def span_borders(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        s = border_states(zeros(t.column("m")))
        return pa.table({"key": t.column("key"), "b": t.column("b"), "from": pa.array(s[:-1], pa.int32()), "to": pa.array(s[1:], pa.int32())})

    def borders(t: pa.Table) -> pa.Table:
        t = t.sort_by("c")
        s = border_states(zeros(t.column("m")), t.column("from")[0].as_py(), t.column("to")[0].as_py())
        return pa.table({"key": t.column("key"), "c": t.column("c"), "entry": pa.array(s[:-1], pa.int32()), "exit": pa.array(s[1:], pa.int32())})

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for big in batches:
            for b in slices(big, "part", SLICE):
                ids = chunks_ids(vocab, list(zip(*[b.column(c).to_pylist() for c in ("part", "back", "n", "entry", "exit")], strict=True)))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("c"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "c", "ids"])
                del ids
                trim_memory()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for big in batches:
            for b in slices(big, "_text", SLICE):
                same = [decode_ids(vocab, i.as_py()) == t.as_py() for i, t in zip(b.column("ids"), b.column("_text"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in columns], b.column("ids"), pc.list_value_length(b.column("ids")).cast(pa.int64()), pa.array(same)],
                    names=[*columns, "ids", "n_pieces", "round_trip"])
                trim_memory()

    solved = chunks.mapInArrow(matrices, "key string, c int, m array<int>").withColumn("b", F.expr(f"c div {SPAN}"))
    solved = materialize(solved, "piece-matrices")
    outer = solved.groupBy("key", "b").applyInArrow(spans, "key string, b bigint, m array<int>").groupBy("key") \
        .applyInArrow(span_borders, "key string, b bigint, from int, to int")
    steps = solved.join(outer, ["key", "b"]).groupBy("key", "b").applyInArrow(borders, "key string, c int, entry int, exit int")
    coded = chunks.join(steps, ["key", "c"]).mapInArrow(paths, "key string, c int, ids array<int>")
    whole_ids = coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))
    big_rows = rows.where(giant).withColumn("key", key).join(whole_ids, "key").select(*columns, "_text", "ids")
    return plain.unionByName(big_rows.mapInArrow(decoded, schema))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode(docs, read_model(spark), ["doc_id"]).select("doc_id", "n_pieces", "ids", "round_trip")


@plain_names
def stage_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their piece ids."""
    return encode(docs, read_model(spark), docs.columns)
