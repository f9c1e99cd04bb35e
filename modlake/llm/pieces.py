"""Offset-preserving SentencePiece BPE: normalise with source alignment, merge, project pieces to byte spans."""

from __future__ import annotations

import functools
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

SPACE = "▁"
_NO_PAIR = 1 << 62


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message, nested ones as bytes."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[i : i + size]
            i += size


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings over a pool of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length in bytes and replacement of the longest entry that ``data`` has at ``at``."""
        units = self.units
        if not units:
            return None
        shift = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        best, node = None, shift(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= shift(units[node])
            if leaf:
                value = units[node] & 0x7FFFFFFF
                best = (k - at + 1, self.pool[value : self.pool.index(b"\0", value)])
        return best


class Pairs(dict):
    """What two neighbouring pieces make: place in the order of merges above 17 bits of id, or -1; found when asked for."""

    LIMIT = 1_000_000

    def __init__(self, pieces: list[str], made: dict[str, int]):
        self.pieces, self.made = pieces, made

    def __missing__(self, pair: tuple[int, int]) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        a, b = pair
        v = self[pair] = -1 if a < 0 or b < 0 else self.made.get(self.pieces[a] + self.pieces[b], -1)
        return v


class PieceModel:
    """Encoder and decoder for a BPE ``.model`` file."""

    WORDS = 600_000  # units remembered at most; then the memory starts anew
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.squeeze, self.escape, charsmap, suffix = True, True, True, b"", False
        unk_surface = " ⁇ "
        for tag, value in _fields(open(path, "rb").read()):
            if tag == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for t, v in _fields(value):
                    if t == 1:
                        piece = v.decode("utf-8")
                    elif t == 2:
                        score = struct.unpack("<f", v)[0]
                    elif t == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif tag == 2:
                for t, v in _fields(value):
                    suffix = bool(v) if t == 24 else suffix
                    unk_surface = v.decode("utf-8") if t == 44 else unk_surface
            elif tag == 3:
                for t, v in _fields(value):
                    if t == 2:
                        charsmap = v
                    elif t == 3:
                        self.dummy_prefix = bool(v)
                    elif t == 4:
                        self.squeeze = bool(v)
                    elif t == 5:
                        self.escape = bool(v)
        if suffix or not self.escape:
            raise ValueError("models that put the blank after a word, or keep it unescaped, are not handled")
        self.map = CharacterMap(charsmap)
        self.unk_surface = unk_surface
        self.id_of = {p: i for i, p in enumerate(self.pieces)}
        self.normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (self.NORMAL, self.USER)}
        self.unk = self.kinds.index(self.UNKNOWN)
        self.bos, self.eos = self.id_of.get("<s>"), self.id_of.get("</s>")
        self.byte_ids = [self.id_of.get(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(i is not None and self.kinds[i] == self.BYTE for i in self.byte_ids)
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i is not None}
        if self.USER in self.kinds:
            raise ValueError("models with user-defined pieces are not handled")
        place = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.normal.values()}, reverse=True))}
        self.pairs = Pairs(self.pieces, {p: place[self.scores[i]] << 17 | i for p, i in self.normal.items()})
        #: If no piece has a blank behind another character, no merge crosses the place before a blank.
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.normal)
        self.chunk = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.by_code = np.full(0x110000, -1, np.int64)
        singles = [p for p in self.normal if len(p) == 1]
        self.by_code[list(map(ord, singles))] = [self.normal[p] for p in singles]
        #: Units between blanks can be normalised each for itself where nothing is mapped, dropped or put together.
        self.by_unit = self.chunked and not self.map.units and not self.squeeze and self.dummy_prefix
        self.units = Units(self, self.WORDS)
        marks = {self.UNKNOWN: unk_surface.encode("utf-8"), self.CONTROL: b""}
        surfaces = [marks.get(k, bytes([self.byte_of[i]]) if k == self.BYTE else p.replace(SPACE, " ").encode("utf-8")) for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        #: What each id decodes to, and behind these what it decodes to at the beginning of a text.
        self.surfaces = pa.array([*surfaces, *(x.removeprefix(b" ") if self.dummy_prefix else x for x in surfaces)], pa.large_binary())

    # -- normalisation -------------------------------------------------------------------------------------------
    def normalise(self, text: str, prefix: bool = True) -> tuple[str, list[int]]:
        """The normalised text with, for each of its characters and for its end, the byte of ``text`` it comes from.

        At each place the longest entry of the character map is taken, else one character. An empty text stays empty.
        ``prefix``: whether this is the beginning of a text, where the model may want a blank.
        """
        if not self.map.units and not self.squeeze:  # at every place one character is the longest
            lead = self.dummy_prefix and prefix and text != ""
            source = range(len(text) + 1) if text.isascii() else [0, *itertools.accumulate(len(c.encode("utf-8")) for c in text)]
            return SPACE * lead + text.replace(" ", SPACE), [*[0] * lead, *source]
        data = text.encode("utf-8")
        out: list[str] = []
        source: list[int] = []
        at = 0

        def step(at: int) -> tuple[str, int]:
            hit = self.map.longest(data, at)
            if hit:
                return hit[1].decode("utf-8"), hit[0]
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return data[at : at + size].decode("utf-8"), size

        if self.squeeze:
            while at < len(data) and step(at)[0] in (" ", ""):
                at += step(at)[1]
        if at >= len(data):
            return "", [len(data)]
        if self.dummy_prefix and prefix:
            out.append(SPACE)
            source.append(at)
        blank = self.squeeze
        while at < len(data):
            new, size = step(at)
            if blank:
                new = new.lstrip(" ")
            for c in new:
                out.append(SPACE if c == " " else c)
                source.append(at)
            if new or not blank:
                blank = self.squeeze and new.endswith(" ")
            at += size
        if self.squeeze:
            while out and out[-1] == SPACE:
                out.pop()
                at = source.pop()
        source.append(at)
        return "".join(out), source

    # -- merging -------------------------------------------------------------------------------------------------
    def merge(self, text: str) -> list[tuple[int, int]]:
        """``(id, start)`` of the symbols of a normalised text after all merges; id -1 for a character without a piece.

        The best piece is made first, the leftmost among equals.
        """
        ids = [self.normal.get(c, -1) for c in text]
        n, pairs = len(ids), self.pairs
        heap = [(v >> 17) * n + i for i, v in enumerate(map(pairs.__getitem__, zip(ids, ids[1:]))) if v >= 0]
        if not heap:
            return list(zip(ids, range(n)))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if j >= n or ids[i] == -2:
                continue
            v = pairs[ids[i], ids[j]]
            if v < 0 or v >> 17 != r:
                continue  # one of the two has gone into another merge
            new = ids[i] = v & 0x1FFFF
            ids[j] = -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                v = pairs[new, ids[k]]
                if v >= 0:
                    push(heap, (v >> 17) * n + i)
            k = before[i]
            if k >= 0:
                v = pairs[ids[k], new]
                if v >= 0:
                    push(heap, (v >> 17) * n + k)
        return [(s, i) for i, s in enumerate(ids) if s != -2]

    @functools.cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of pieces that make a piece, as ``left << 17 | right``, ascending, and what pairs[] gives for each."""
        get, rows = self.normal.get, []
        for p in self.normal:
            for k in range(1, len(p)):
                a, b = get(p[:k]), get(p[k:])
                if a is not None and b is not None:
                    rows.append((a << 17 | b, self.pairs.made[p]))
        key, value = np.array(sorted(rows), np.int64).reshape(-1, 2).T
        return key, value

    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What neighbours a and b make, as in pairs[], or _NO_PAIR."""
        key, value = self.pair_table
        want = np.where((a >= 0) & (b >= 0), a << 17 | b, -1)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[at] == want, value[at], _NO_PAIR)

    def merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What merge() gives for many short texts, one after the other in ``ids`` by character (-1: no piece).

        Returns owner, id, first character and number of characters of each symbol left. All texts of like length take
        a step together: each makes its best piece, the leftmost among equals.
        """
        first, order, out = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable"), []
        for lo in range(0, len(order), 20_000):
            rows = order[lo : lo + 20_000]
            n = sizes[rows]
            cols = np.arange(int(n[-1]))
            there = cols < n[:, None]
            s, w = np.full(there.shape, -1, np.int64), there.astype(np.int64)
            s[there] = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)]
            v, live = self._values(s[:, :-1], s[:, 1:]), np.arange(len(rows))
            while v.shape[1]:
                rank = v[live] >> 17
                j = rank.argmin(axis=1)
                ok = rank[np.arange(len(live)), j] < _NO_PAIR >> 17
                live, j = live[ok], j[ok]
                if not len(live):
                    break
                at = np.arange(len(live))
                new, joined = v[live, j] & 0x1FFFF, w[live, j] + w[live, j + 1]
                after = np.minimum(cols + (cols > j[:, None]), len(cols) - 1)
                s_, w_ = np.take_along_axis(s[live], after, 1), np.take_along_axis(w[live], after, 1)
                s_[:, -1], w_[:, -1] = -1, 0
                s_[at, j], w_[at, j] = new, joined
                v_ = np.take_along_axis(v[live], np.minimum(after[:, :-1], len(cols) - 2), 1)
                v_[:, -1] = _NO_PAIR
                left, right = j > 0, j < len(cols) - 1
                v_[at[left], j[left] - 1] = self._values(s_[at[left], j[left] - 1], new[left])
                v_[at[right], j[right]] = self._values(new[right], s_[at[right], j[right] + 1])
                s[live], w[live], v[live] = s_, w_, v_
            left = w > 0
            out.append((np.repeat(rows, left.sum(axis=1)), s[left], (np.cumsum(w, axis=1) - w)[left], w[left]))
        owner, symbol, start, width = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(owner, kind="stable")
        return owner[order], symbol[order], start[order], width[order]

    def normalise_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """normalise() of many units of a model without map entries, where at every place one character is the longest.

        Characters of all units, their number for each, the byte in its unit that each comes from (and one more for
        each unit's end), and the bytes before each unit. Units have blanks at their beginning only, and no SPACE.
        """
        text = "".join([u if u[0] == " " else SPACE + u for u in units])
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) + (u[0] != " ") for u in units], np.int64)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        size[code == ord(SPACE)] = 0  # put before a text, from no byte
        upto, ends = np.append(0, np.cumsum(size)), np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes + 1)
        bytes_before = upto[ends - sizes]
        source = upto[np.arange(len(unit)) - unit] - bytes_before[unit]
        return np.where(code == 32, ord(SPACE), code), sizes, source, bytes_before

    def spans_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``n`` pieces of each unit and ``[3, pieces]`` their ids, starts and ends; a unit without blank before it begins a text."""
        code, sizes, source, bytes_before = self.normalise_all(units)
        owner, symbol, start, width = self.merge_all(self.by_code[code], sizes)
        char = (np.cumsum(sizes) - sizes)[owner] + start
        if self.fallback:
            times = np.where(symbol < 0, source[char + owner + 1] - source[char + owner], 1)
            of = np.repeat(np.arange(len(symbol)), times)
            data = np.frombuffer("".join(units).encode("utf-8"), np.uint8)
            place = bytes_before[owner[of]] + source[char + owner][of] + np.arange(len(of)) - (np.cumsum(times) - times)[of]
            ids = np.where(symbol[of] < 0, np.array(self.byte_ids)[data[np.minimum(place, len(data) - 1)]], symbol[of])
        else:
            times, of = np.ones(len(symbol), np.int64), np.arange(len(symbol))
            ids = np.where(symbol < 0, self.unk, symbol)
        n = np.bincount(owner, times, len(units)).astype(np.int64)
        return n, np.stack([ids, source[char + owner][of], source[char + width + owner][of]])

    def _spelt(self, chunk: str, done: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What merge() gave, with characters without a piece spelt in bytes."""
        out = []
        for s, i in done:
            if s >= 0:
                out.append((s, i))
            elif self.fallback:
                out += [(self.byte_ids[b], i) for b in chunk[i].encode("utf-8")]
            else:
                out.append((self.unk, i))
        return out

    def spans(self, text: str, prefix: bool = True) -> list[tuple[int, int, int]]:
        """``(id, start, end)`` of every piece, with the bytes of ``text`` that it stands for.

        The bytes of one character spelt in byte pieces share that character's span; a blank put before the text
        has none (start = end).
        """
        norm, source = self.normalise(text, prefix)
        out, at = [], 0
        for chunk in self.chunk.findall(norm) if self.chunked else [norm] if norm else []:
            done = self._spelt(chunk, self.merge(chunk))
            end, ends = len(chunk), []
            for k in range(len(done) - 1, -1, -1):
                if k + 1 < len(done) and done[k + 1][1] > done[k][1]:
                    end = done[k + 1][1]
                ends.append(end)
            out += [(piece, source[at + i], source[at + e]) for (piece, i), e in zip(done, reversed(ends))]
            at += len(chunk)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids with begin and end."""
        return [self.bos, *(i for i, _, _ in self.spans(text or "")), self.eos]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``sizes`` of the texts (null: empty) in pieces, and the pieces' ids, starts and ends, one text after the other.

        Where units between blanks stand for themselves, each distinct one is normalised, merged and projected once;
        a text is its units' pieces, shifted to where they stand in it. Texts with runs of blanks, or blanks at an end,
        and all texts of other models, are gone through whole.
        """
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), bool)
        if self.by_unit:
            odd = pc.match_substring_regex(texts, f"^ |  | $|\n $|{SPACE}|^$").to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        edges = words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        new = [*(" " + w for w in flat.dictionary.to_pylist()), *flat.dictionary.take(flat.indices.take(pa.array(edges[:-1]))).to_pylist()]
        whole = texts.filter(pa.array(odd)).to_pylist()
        unit = self.units.places(new)
        own = unit[flat.indices.to_numpy()]
        own[edges[:-1]] = unit[len(flat.dictionary) :]  # the first of a text has no blank before it
        n, first, length = self.units.get(own)
        stop = np.cumsum(length)
        begin = stop - length
        begin -= np.repeat(begin[edges[:-1]], np.diff(edges))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        ids, shift = self.units.ids[at], np.repeat(begin, n)
        start, end = self.units.start[at] + shift, self.units.end[at] + shift
        upto = np.append(0, np.cumsum(n))[edges]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = np.diff(upto)
        if not len(whole):
            return sizes, ids, start, end
        rows = [self.spans(t) for t in whole]
        sizes[odd] = list(map(len, rows))
        flat_rows = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3)
        of_odd = np.repeat(odd, sizes)
        out = np.empty((3, len(of_odd)), np.int64)
        out[:, ~of_odd] = ids, start, end
        out[:, of_odd] = flat_rows.T
        return sizes, *out

    # -- decoding ------------------------------------------------------------------------------------------------
    def _text(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i) if i >= 0 else None
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_lossy(bytes(run)))
                run.clear()
            if i >= 0 and self.kinds[i] == self.UNKNOWN:
                out.append(self.unk_surface)
            elif i >= 0 and self.kinds[i] != self.CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 give one U+FFFD each."""
        out = self._text(ids)
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """decode() of many lists of ids, one after the other; begin and end, which have no text, may be left out."""
        own = ids.copy()
        own[edges[:-1][np.diff(edges) > 0]] += len(self.pieces)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), self.surfaces.take(pa.array(own))), pa.scalar(b"", pa.large_binary()))
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(edges, edges[1:])], pa.string())


def _lossy(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") + "�" + _lossy(data[e.start + 1 :])


class Units:
    """Distinct units with their pieces: ids, and start and end in the unit's bytes, in growing arrays."""

    def __init__(self, model: PieceModel, limit: int):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.n, self.first, self.length = (np.empty(0, np.int64) for _ in range(3))
        self.ids, self.start, self.end = (np.empty(0, np.int64) for _ in range(3))

    def places(self, units: list[str]) -> np.ndarray:
        """The places of the units, new ones learnt; places of an earlier call may no longer hold."""
        if len(self.place) > self.limit:
            self.clear()
        fresh = [u for u in dict.fromkeys(units) if u not in self.place]
        if fresh:
            known = len(self.place)
            self.place.update(zip(fresh, range(known, known + len(fresh))))
            n, pieces = self.learn(fresh)
            self.first = np.append(self.first, len(self.ids) + np.cumsum(n) - n)
            self.n, self.length = np.append(self.n, n), np.append(self.length, [len(u.encode("utf-8")) for u in fresh])
            self.ids, self.start, self.end = (np.append(a, b) for a, b in zip((self.ids, self.start, self.end), pieces))
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Short units all together; long ones, of which there are few, by the heap."""
        short = np.array([len(u) < 48 for u in units], bool)
        n = np.zeros(len(units), np.int64)
        rows = [self.model.spans(u, not u.startswith(" ")) for u, s in zip(units, short) if not s]
        n[~short] = list(map(len, rows))
        if short.any():
            n[short], pieces = self.model.spans_all([u for u, s in zip(units, short) if s])
        if not rows:
            return n, pieces
        of = np.repeat(short, n)
        out = np.empty((3, len(of)), np.int64)
        if short.any():
            out[:, of] = pieces
        out[:, ~of] = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3).T
        return n, out

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of pieces, place of the first, and bytes of each unit."""
        return self.n[places], self.first[places], self.length[places]


@functools.cache
def worker_model(path: str) -> PieceModel:
    """The model of this Python worker: later tasks of the worker find it read, and its units remembered."""
    return PieceModel(path)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes or one text."""
    total = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, to
        at = to


def encode_pieces(docs: DataFrame, model: str, slice_bytes: int = 1 << 22) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids, spans, decoded``.

    ids are little-endian 32-bit integers with begin and end; spans the start and end byte, 32 bits each, of every
    piece between those two; decoded is what decode(ids) gives. A null text counts as empty (begin and end only).
    Texts of any length are encoded whole, repeated rows give repeated rows, an empty table gives none; other columns
    are not looked at. No shuffle; about ``slice_bytes`` of text are worked on at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_model(model)
        for b in batches:
            for at, to in _slices(b.column("text"), slice_bytes):
                sizes, ids, start, end = m.encode_all(b.column("text").slice(at, to - at))
                edges = np.append(0, np.cumsum(sizes))
                marked = np.empty(len(ids) + 2 * len(sizes), "<u4")
                inside = np.ones(len(marked), bool)
                first, last = edges[:-1] + 2 * np.arange(len(sizes)), edges[1:] + 2 * np.arange(len(sizes)) + 1
                inside[first] = inside[last] = False
                marked[first], marked[last], marked[inside] = m.bos, m.eos, ids
                spans = np.stack([start, end], 1).astype("<u4")
                raw = lambda data, n: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(n.astype(np.int32)), pa.py_buffer(data)])
                cols = [b.column("doc_id").slice(at, to - at), pa.array(sizes + 2), raw(marked, np.append(first, len(marked)) * 4), raw(spans, edges * 8), m.decode_all(ids, edges)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "spans", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, spans binary, decoded string")
