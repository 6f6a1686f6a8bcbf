"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list fixes, for every text, one sequence of tokens.  Two facts make streaming possible.  A boundary that
stands in the final sequence splits the text into parts that tokenize independently; and whether two neighbouring
tokens stay apart can be told from their merge trees alone (``apart``).  So a window of the text is tokenized from
its last final boundary on by taking longest matches and stepping back where neighbours would not stay apart, and
a token is emitted once ``lookahead`` further symbols were seen: the merge list's own bound on how far to the right
anything can still change it (``_lookahead``).  A window is never longer than the longest token plus that bound; a
word that is shorter than a token may be needs no windows, and is merged by rank.

Words are cut as the tokenizer file says (NFC, white space, lower case, its pattern); only files of that kind, with an
end-of-word suffix and byte symbols, are accepted.  Texts are read from their Arrow buffers in segments of bounded size, cut
at white space.  The chunks between white space of a segment are hashed, each distinct one is encoded once, and what
it became is kept in a table of bounded size, so most of a text's ids are gathered from there.  A run without white space that is
longer than a segment goes through normalisation, words and windows block by block.  So beside the text itself and its
result memory is constant, however long a text or a word is.

Decoding turns ids back into text by an incremental machine: it takes ids in pieces of any size, and holds
no more than whether a token came before (``Decoder``, which joins token strings by spaces, as the library does for a file
without a decoder) or the bytes of an unfinished character (``TextDecoder``, which gives readable text).

Null and empty texts give no tokens; texts of any length are encoded whole; repeated rows give the same tokens; an empty
table gives an empty result; extra columns are carried along, and an output name that clashes with one is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardline.llm.arrowtext import SPACE as BLANK
from wardline.llm.arrowtext import hashed, utf8
from wardline.llm.common import lean, release

END = "\x00"  # marks the last symbol of a word inside this module; bytes are mapped away from it
SPACE = r"\t-\r \x85\xa0  -     　"
NEVER = 1 << 60  # above any rank with an id
#: Bytes of a segment, of the blocks of a longer run, and bounds of the table of chunks: chunks, and ids in all.
SEGMENT, LONG_BLOCK = 1 << 19, 1 << 16
CHUNKS, POOL = 400_000, 2_000_000


def byte_symbols() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes are themselves, others are moved past 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


class Transducer:
    """Encodes single words; ``lookahead`` and ``longest`` are in symbols."""

    #: Pairs of tokens that are remembered.
    PAIRS = 60_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        one: dict[str, str] = {}  # one object for equal strings

        def fold(s: str) -> str:
            s = s[: -len(suffix)] + END if s.endswith(suffix) and s != suffix else s
            return one.setdefault(s, s)

        self.ids = {fold(s): i for s, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for r, (a, b) in enumerate(merges):
            a, b = fold(a), fold(b)
            if (a, b) not in self.rank:
                self.rank[a, b] = r
                self.parts.setdefault(one.setdefault(a + b, a + b), (a, b))
        #: By both ids of a pair: the rank of its merge, and the id that it gives.
        self.merge = {self.ids[a] << 20 | self.ids[b]: r << 20 | self.ids[a + b] for (a, b), r in self.rank.items()}
        self._apart: dict[tuple[str, str], bool] = {}
        good: set[str] = {s for s in self.ids if self.size(s) == 1}
        for t, (a, b) in self.parts.items():
            r = self.rank[a, b]
            if t in self.ids and a in good and b in good and not self._joined(a, b, r, r):
                good.add(t)
        self.good = good
        self.longest = max(map(self.size, good))
        self.shorter: dict[str, str | None] = {}
        self.reach: dict[str, int] = {}
        for t in good:
            if len(t) > 3:
                self.reach[t[:4]] = max(self.reach.get(t[:4], 4), len(t))
        self.lookahead = self._lookahead()

    @staticmethod
    def size(t: str) -> int:
        return len(t) - (t[-1:] == END)

    def spine(self, t: str, last: int, right: bool) -> list[tuple[str, int]]:
        """The tokens at t's right (left) edge in turn, each with the rank at which it is merged away."""
        out, until = [], last
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out
            a, b = self.parts[t]
            until, t = self.rank[a, b], (b if right else a)

    def _joined(self, a: str, b: str, ra: int, rb: int) -> bool:
        """Does a merge over the border come first, when a lasts until ra and b until rb?"""
        top = (a, b)
        left = self.spine(b, rb, False)
        for s, until in self.spine(a, ra, True):
            for p, till in left:
                if (s, p) == top and ra == rb != NEVER:
                    continue
                r = self.rank.get((s, p))
                if r is not None and r < until and r <= till:
                    return True
        return False

    def apart(self, a: str, b: str) -> bool:
        """Is the sequence a, b what the text a + b becomes?"""
        found = self._apart.get((a, b))
        if found is None:
            if len(self._apart) > self.PAIRS:
                self._apart.clear()
            found = self._apart[a, b] = not self._joined(a, b, NEVER, NEVER)
        return found

    def _lookahead(self) -> int:
        """How many symbols after a token can decide whether it stays.

        A token gives way only to a merge of something at its right edge with a following y, of lower rank than what
        holds that edge together; y itself must last until then, which symbols further on decide, by merges of still lower
        rank.  So the bounds are filled in by rising rank.
        """
        ranks: dict[str, list[int]] = {}
        most: dict[str, list[int]] = {}

        def bound(t: str, last: int) -> int:
            best = 0
            for s, until in self.spine(t, last, True):
                if s in ranks and (k := bisect_left(ranks[s], until)):
                    best = max(best, most[s][k - 1])
            return best

        for (a, b), r in sorted(self.rank.items(), key=lambda x: x[1]):
            need = self.size(b) + bound(b, r)
            seen = most.setdefault(a, [])
            ranks.setdefault(a, []).append(r)
            seen.append(max(need, seen[-1] if seen else 0))
        return max((bound(t, NEVER) for t in self.good), default=0)

    def _match(self, w: str, at: int) -> str:
        """Longest token at a place."""
        good, most = self.good, self.reach.get(w[at : at + 4])
        if most:
            for end in range(min(len(w), at + most), at + 3, -1):
                if (t := w[at:end]) in good:
                    return t
        for end in range(min(len(w), at + 3), at, -1):
            if (t := w[at:end]) in good:
                return t
        raise ValueError(f"no token for {w[at : at + 1]!r}")

    def _shorter(self, t: str) -> str | None:
        if t not in self.shorter:
            self.shorter[t] = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.good), None)
        return self.shorter[t]

    def window(self, w: str) -> list[str]:
        """All tokens of a window, which ends in END only at the end of the word."""
        if w in self.good:
            return [w]
        out: list[str] = []
        known, n = self._apart, len(w)
        at, t, last = 0, self._match(w, 0), None
        bad: set[int] = {n - 1} if w[-1] == END else set()  # the last symbol and its end mark are one
        while True:
            while t is not None:
                if at + len(t) not in bad:
                    if last is None:
                        break
                    ok = known.get((last, t))
                    if ok or (ok is None and self.apart(last, t)):
                        break
                t = self._shorter(t)
            if t is None:
                bad.add(at)
                t = out.pop()
                at -= len(t)
                last = out[-1] if out else None
                t = self._shorter(t)
                continue
            out.append(t)
            at += len(t)
            if at == n:
                return out
            last, t = t, self._match(w, at)

    def short(self, word: str) -> list[int]:
        """Ids of a word that fits into a window: merged by rank, the leftmost of equals first."""
        ids, get = self.ids, self.merge.get
        parts = [ids[c] for c in word[:-1]]
        parts.append(ids[word[-1] + END])
        ways = [get(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ways and (best := min(ways)) != NEVER:
            i = ways.index(best)
            parts[i] = made = best & 0xFFFFF
            del parts[i + 1], ways[i]
            if i:
                ways[i - 1] = get(parts[i - 1] << 20 | made, NEVER)
            if i < len(ways):
                ways[i] = get(made << 20 | parts[i + 1], NEVER)
        return parts

    def tokens(self, word: str) -> Iterator[str]:
        """Tokens of a word of byte symbols, each emitted as soon as it is stable."""
        w = Word(self)
        yield from w.feed(word)
        yield from w.end()


class Word:
    """A word that comes in pieces: gives out tokens as soon as they are stable, and holds a window at most."""

    def __init__(self, machine: Transducer):
        self.machine, self.held = machine, ""

    def feed(self, symbols: str) -> Iterator[str]:
        m = self.machine
        held, at, room = self.held + symbols, 0, m.longest + m.lookahead
        while len(held) - at > room:
            final, seen = at, 0
            for t in m.window(held[at : at + room]):
                seen += m.size(t)
                if seen > m.longest:
                    break
                yield t
                final += len(t)
            at = final
        self.held = held[at:]

    def end(self) -> Iterator[str]:
        if self.held:
            yield from self.machine.window(self.held + END)
        self.held = ""


class Chunks:
    """What chunks of text became, by the hash of their bytes: sorted arrays and one pool of ids, of bounded size."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.pool, self.size = np.zeros(1 << 12, np.int32), 0

    def places(self, hashes: np.ndarray, encode: Callable[[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids begin in the pool, and how many they are; encode gives those of the chunk at a place."""
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        k = np.searchsorted(self.keys, u)
        fresh = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] != u if len(self.keys) else np.ones(len(u), bool))
        if len(fresh):
            if len(self.keys) + len(fresh) > CHUNKS or self.size > POOL:
                self._forget()
                return self.places(hashes, encode) if len(self.keys) else self._put(u, first, inverse, np.arange(len(u)), encode)
            return self._put(u, first, inverse, fresh, encode)
        self.used[k] = True
        return self.at[k][inverse], self.n[k][inverse]

    def _put(self, u: np.ndarray, first: np.ndarray, inverse: np.ndarray, fresh: np.ndarray, encode: Callable[[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        got = [encode(i) for i in first[fresh].tolist()]
        n = np.array([len(g) for g in got], np.int32)
        flat = np.array([i for g in got for i in g], np.int32)
        if self.size + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool[: self.size], np.zeros(max(len(flat), self.size // 2), np.int32)]
        self.pool[self.size : self.size + len(flat)] = flat
        at = (self.size + np.cumsum(n) - n).astype(np.int32)
        self.size += len(flat)
        to = np.searchsorted(self.keys, u[fresh])
        self.keys, self.at, self.n = np.insert(self.keys, to, u[fresh]), np.insert(self.at, to, at), np.insert(self.n, to, n)
        self.used = np.insert(self.used, to, False)
        k = np.searchsorted(self.keys, u)
        self.used[np.setdiff1d(k, k[fresh], assume_unique=True)] = True
        return self.at[k][inverse], self.n[k][inverse]

    def _forget(self) -> None:
        """Keeps what was asked for again since the last time, unless that is more than half."""
        keep = np.flatnonzero(self.used)
        total = int(self.n[keep].sum())
        if not len(keep) or len(keep) > CHUNKS // 2 or total > POOL // 2:
            return self.clear()
        self.keys, at, self.n = self.keys[keep], self.at[keep], self.n[keep]
        self.pool, self.at, self.size = gathered(self.pool, at, self.n), (np.cumsum(self.n) - self.n).astype(np.int32), total
        self.used = np.zeros(len(keep), bool)


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches at .. at + n of a pool, one after the other."""
    end = np.cumsum(n)
    return pool[np.repeat(at - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


class Codec:
    """A tokenizer file: cutting texts into words, words into ids, and ids into text."""

    #: Words that are remembered, in two generations.
    CACHE = 20_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("only BPE files with an end-of-word suffix, NFC, white space and lower case, and no decoder are read")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, suffix)
        self.suffix = suffix
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for name, i in [*model["vocab"].items(), *self.special.items()]:
            self.names[i] = name
        self.digits = [str(i) for i in range(len(self.names))]
        self.cut_special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern)
        self.kinds = [regex.compile(x) for x in pattern.split("|") if x.endswith("+")]
        self.symbol = {b: s for b, s in byte_symbols().items()}
        self.chunks = Chunks()
        self.known: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def symbols(self, w: str) -> str:
        return w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.symbol)

    def word(self, w: str) -> list[int]:
        found = self.known.get(w) or self.old.get(w)
        if found is None:
            s, m = self.symbols(w), self.machine
            found = m.short(s) if len(s) < m.longest else [m.ids[t] for t in m.tokens(s)]
            if len(w) > m.longest:
                return found
        if len(self.known) >= self.CACHE:  # what was asked for since the last change stays
            self.old, self.known = self.known, {}
        self.known[w] = found
        return found

    @staticmethod
    def normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunk(self, text: str) -> list[int]:
        """Ids of a run without white space."""
        text = self.normal(text)
        if text.isalpha():
            return self.word(text)
        out: list[int] = []
        for w in self.words.findall(text):
            out += self.word(w)
        return out

    def long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of a run without white space of any length, block by block."""
        read = codecs.getincrementaldecoder("utf-8")()
        raw, text, word, kind, ids = "", "", None, None, self.machine.ids
        for lo in range(0, max(1, len(data)), LONG_BLOCK):
            final = lo + LONG_BLOCK >= len(data)
            raw += read.decode(data[lo : lo + LONG_BLOCK].tobytes(), final)
            k = len(raw) if final else safe_cut(raw)
            text, raw, at = text + self.normal(raw[:k]), raw[k:], 0
            out: list[int] = []
            while at < len(text):
                if word:
                    if m := kind.match(text, at):
                        out += [ids[t] for t in word.feed(self.symbols(m.group()))]
                        at = m.end()
                    if at == len(text):
                        break
                    out += [ids[t] for t in word.end()]
                    word = None
                m = self.words.search(text, at)
                if not m:
                    at = len(text)
                elif m.end() < len(text) or final:
                    if len(text) - m.start() < 8 and not final:  # signs to come may make it another word
                        at = m.start()
                        break
                    out += self.word(m.group())
                    at = m.end()
                else:
                    at = m.start()
                    kind = next((x for x in self.kinds if x.fullmatch(m.group())), None)
                    if len(m.group()) < 8 or not kind:
                        break
                    word = Word(self.machine)
            text = text[at:]
            if final and word:
                out += [ids[t] for t in word.end()]
            yield np.array(out, np.int32)

    def rows(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of a column's texts in pieces, in order; rows without tokens are left out."""
        offs, data = utf8(col)
        for lo, hi, what in self._segments(offs, data):
            row = int(np.searchsorted(offs, lo, "right")) - 1
            if what is None:
                for ids in self.long(data[lo:hi]):
                    if len(ids):
                        yield row, ids
            elif what >= 0:
                yield row, np.array([what], np.int32)
            else:
                borders = offs[row + 1 : int(np.searchsorted(offs, hi, "left"))] - lo
                starts, ends, hashes = hashed(data[lo:hi], borders)
                if not len(starts):
                    continue
                blob, s, e = data[lo:hi].tobytes(), starts.tolist(), ends.tolist()
                at, n = self.chunks.places(hashes, lambda i: self.chunk(blob[s[i] : e[i]].decode()))
                flat, end = gathered(self.chunks.pool, at, n), np.cumsum(n)
                whose = row + np.searchsorted(borders, starts, "right")
                last = np.flatnonzero(np.r_[whose[1:] != whose[:-1], True])
                for r, a, z in zip(whose[last].tolist(), [0, *end[last[:-1]].tolist()], end[last].tolist()):
                    if z > a:
                        yield r, flat[a:z]

    def _segments(self, offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int | None]]:
        """(from, to, kind): stretches of the bytes, each of whole rows or of one row's part, cut at white space.

        kind: -1 for an ordinary stretch, None for a run without white space that is longer than a segment, else the id of the
        special token that stands there.
        """
        marks = [(int(offs[0]), int(offs[0]), -1)]
        if self.cut_special:
            for m in self.cut_special.finditer(memoryview(data[offs[0] : offs[-1]])):
                lo, hi = offs[0] + m.start(), offs[0] + m.end()
                if np.searchsorted(offs, lo, "right") == np.searchsorted(offs, hi - 1, "right"):  # within one row
                    marks.append((int(lo), int(hi), self.special[m.group().decode()]))
        for (_, pos, _), (end, until, special) in zip(marks, [*marks[1:], (int(offs[-1]), 0, -1)]):
            while pos < end:
                hi = min(pos + SEGMENT, end)
                if hi < end and (border := int(offs[np.searchsorted(offs, hi, "right") - 1])) > pos:
                    hi = border
                elif hi < end:
                    blank = np.flatnonzero(BLANK[data[pos:hi]])
                    if len(blank):
                        hi = pos + int(blank[-1]) + 1
                    else:
                        most = min(end, int(offs[np.searchsorted(offs, pos, "right")]))
                        while hi < most:
                            blank = BLANK[data[hi : min(most, hi + SEGMENT)]]
                            hi += int(np.argmax(blank)) if blank.any() else len(blank)
                            if blank.any():
                                break
                        yield pos, hi, None
                        pos = hi
                        continue
                yield pos, hi, -1
                pos = hi
            if until:
                yield end, until, special

    def encode(self, text: str | None) -> list[int]:
        return [i for _, ids in self.rows(pa.array([text], pa.string())) for i in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode for a file without a decoder."""
        return Decoder(self).feed(np.array(ids, np.int32)).decode()

    def text_decoder(self) -> TextDecoder:
        return TextDecoder(self)


def safe_cut(text: str) -> int:
    """The last place before which nothing changes by normalisation together with what stands behind it."""
    for i in range(len(text) - 1, 0, -1):
        c = text[i]
        if c < "\u0300" or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"):
            return i
    return 0


class Decoder:
    """Ids in, in pieces; UTF-8 bytes of the library's decoded text out."""

    def __init__(self, codec: Codec):
        self.names, self.begun = codec.names, False

    def feed(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        names = self.names
        out = " ".join([names[i] for i in ids.tolist()]).encode()
        lead, self.begun = b" " if self.begun else b"", True
        return lead + out


class TextDecoder:
    """Tokens in, readable text out: bytes of unfinished characters are held back until they are whole."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.byte = {s: b for b, s in codec.symbol.items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        name = self.codec.names[token_id]
        if name in self.codec.special:
            return self.utf8.decode(b"", True) + name
        ends = name.endswith(self.codec.suffix)
        body = name[: -len(self.codec.suffix)] if ends else name
        return self.utf8.decode(bytes(self.byte[c] for c in body)) + (" " if ends else "")

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process; what it remembers is bounded, and stays for the next task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
        release()
    return _codecs[path]


def _fresh(df: DataFrame, *names: str) -> None:
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")


def _lists(found: list[np.ndarray], lengths: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of a text column as array<int>; path: the tokenizer file, present on every node."""
    _fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, found = np.zeros(b.num_rows, np.int64), []
            for row, ids in c.rows(b.column(text)):
                n[row] += len(ids)
                found.append(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(found, n)], [*b.schema.names, out])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", readable: bool = False) -> DataFrame:
    """df with the decoded text; readable: words and their spaces as they were read, instead of token strings."""
    _fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = []
            for row in b.column(ids).to_pylist():
                if readable:
                    d = c.text_decoder()
                    texts.append(("".join(d.feed(i) for i in row or ()) + d.finish()).rstrip(" "))
                else:
                    texts.append(c.decode(row or []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(lean(run), schema)


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without the text, but with n_tokens, ids (array<int>) and decoded_sha256, the digest of what the ids decode to."""
    _fresh(df, "n_tokens", "ids", "decoded_sha256")
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, found, seen = np.zeros(b.num_rows, np.int64), [], Digests(c, b.num_rows)
            for row, ids in c.rows(b.column(text)):
                n[row] += len(ids)
                found.append(ids)
                seen.feed(row, ids)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(n), _lists(found, n), pa.array(seen.decoded(), pa.string())], schema.names)

    return df.mapInArrow(lean(run), schema)


class Digests:
    """Digests of the rows' ids and of the text that these ids decode to; pieces of rows come in order."""

    def __init__(self, codec: Codec, rows: int):
        self.codec, self.row, self.digits = codec, -1, codec.digits
        nothing = hashlib.sha256().hexdigest()
        self.of_ids, self.of_text = [nothing] * rows, [nothing] * rows

    def feed(self, row: int, ids: np.ndarray, both: bool = False) -> None:
        if row != self.row:
            self._close()
            self.row, self.decoder, self.text, self.ids = row, Decoder(self.codec), hashlib.sha256(), hashlib.sha256()
            self.lead = ""
        self.text.update(self.decoder.feed(ids))
        if both:
            self.ids.update((self.lead + " ".join([self.digits[i] for i in ids.tolist()])).encode())
            self.lead = " "

    def _close(self) -> None:
        if self.row >= 0:
            self.of_text[self.row], self.of_ids[self.row] = self.text.hexdigest(), self.ids.hexdigest()

    def decoded(self) -> list[str]:
        self._close()
        return self.of_text


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes its ids, and keeps only digests.

    The ids and the decoded text go into the digests piece by piece, so no whole sequence is held.
    """
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, seen = np.zeros(b.num_rows, np.int64), Digests(c, b.num_rows)
            for row, ids in c.rows(b.column(text)):
                n[row] += len(ids)
                seen.feed(row, ids, both=True)
            texts = seen.decoded()
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n), pa.array(seen.of_ids, pa.string()), pa.array(texts, pa.string())], schema.names)

    return df.select(key, text).mapInArrow(lean(run), schema)
