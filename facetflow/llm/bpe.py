"""Byte-pair encoding by a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols. A leaf of its tree holds the merge rank of the pair that starts there, joined with
the position, so that the root is the leftmost pair of lowest rank. A merge changes three leaves; each change runs up
one path of the tree. The work ends when the root holds no mergeable pair.

Short pre-tokens are merged many at a time: the trees are rows of one numpy array, and every step is taken by all rows
that still have a mergeable pair. Long ones (over ``WIDE`` bytes) get a tree of their own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held_by_worker, slices

#: Longest pre-token, in bytes, that is merged in the shared array.
WIDE = 64
#: Pre-tokens and chunks that a worker remembers; the memory is emptied when full.
REMEMBERED = 700_000
#: Pieces that the library encodes as one text; marks that stand behind words.
TOGETHER, MARKS = 4096, frozenset(".,;:!?")
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves behind U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class MergeTree:
    """The segment tree of one long pre-token."""

    def __init__(self, symbols: list[int], pairs: dict[int, tuple[int, int]], base: int):
        self.symbols, self.pairs, self.base = symbols, pairs, base
        n = len(symbols)
        self.width = 1 << max(0, (n - 1).bit_length())
        self.after = [*range(1, n), -1]
        self.before = [*range(-1, n - 1)]
        self.none = 1 << 62
        self.tree = [self.none] * (2 * self.width)
        for i in range(n - 1):
            self.tree[self.width + i] = self.rank_at(i)
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def rank_at(self, i: int) -> int:
        j = self.after[i]
        found = self.pairs.get(self.symbols[i] * self.base + self.symbols[j]) if j >= 0 else None
        return found[0] << 32 | i if found else self.none

    def put(self, i: int, value: int) -> None:
        tree, i = self.tree, self.width + i
        tree[i] = value
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def merged(self) -> list[int]:
        while (top := self.tree[1]) != self.none:
            i = top & 0xFFFFFFFF
            j = self.after[i]
            self.symbols[i] = self.pairs[self.symbols[i] * self.base + self.symbols[j]][1]
            self.after[i] = k = self.after[j]
            if k >= 0:
                self.before[k] = i
            self.symbols[j] = -1
            self.put(j, self.none)
            self.put(i, self.rank_at(i))
            if (h := self.before[i]) >= 0:
                self.put(h, self.rank_at(h))
        return [s for s in self.symbols if s >= 0]


class BpeModel:
    """Vocabulary, merges and normal form of a byte-level ``tokenizer.json`` file.

    Two kinds of file are handled: with ``end_of_word_suffix`` (text is normalised as the file says, white space dropped)
    and without (white space is part of the pre-tokens).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in chain(vocab.items(), self.specials.items()):
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.first = np.array([vocab.get(c, -1) for c in alphabet], np.int32)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in alphabet], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a later copy of a pair would replace an earlier one
        self.pairs = {vocab[a] * self.size + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array(list(self.pairs), np.int64)
        values = np.array(list(self.pairs.values()), np.int32)
        # an open hash table: slot by multiplication, then the next free one
        self.bits = max(4, len(keys).bit_length() + 2)
        self.slot_keys, self.slot_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        left = np.arange(len(keys))
        at = self.slot_of(keys)
        while len(left):
            free = self.slot_keys[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.slot_keys[at[one]], self.slot_ranks[at[one]] = keys[left[one]], values[left[one], 0]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.made = np.zeros(len(merges), np.int32)
        self.made[values[:, 0]] = values[:, 1]
        steps = json.dumps(spec.get("normalizer") or {})
        self.nfc, self.lower = '"NFC"' in steps, '"Lowercase"' in steps
        found = regex.search(r'"Regex": ("(?:[^"\\]|\\.)*")', json.dumps(spec["pre_tokenizer"]))
        # fixed value: the byte-level scheme's own pattern, where the file states none
        own = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(json.loads(found[1]) if found else own)
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        of = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [bytes(of[c] for c in t) if t not in self.specials and all(c in of for c in t) else t.encode() for t in self.tokens] if self.byte_decoder else []

    # -- text to pre-tokens -------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # letter by letter: a capital sigma at the end of a word has no form of its own here
            text = text.replace("Σ", "σ").lower()
        return text

    def split(self, text: str) -> list[str | int]:
        """Pre-tokens, and special tokens as their ids."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.specials) else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += self.pattern.findall(self.normal(part))
        return out

    def split_many(self, texts: list[str]) -> list[list[str | int]]:
        """As split() of each; what holds for all of them is looked at once, and a text of letters alone is one pre-token."""
        joined = "\n".join(texts)
        if any(s in joined for s in self.specials):
            return [self.split(t) for t in texts]
        if self.nfc or self.lower:
            made = self.normal(joined).split("\n")
            texts = made if len(made) == len(texts) else [self.normal(t) for t in texts]
        find = self.pattern.findall
        if self.suffix:
            return [[t] if t.isalpha() else find(t) for t in texts]
        return [[t] if (t[1:] if t[:1] == " " else t).isalpha() else find(t) for t in texts]

    # -- pre-tokens to ids --------------------------------------------------------------------------------------

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; NONE for those that no merge joins, and where a symbol is missing (-1)."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self.slot_of(key)
        held = self.slot_keys[at]
        rank = np.where(held == key, self.slot_ranks[at], NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slot_keys[at[open_]]
            hit = held == key[open_]
            rank[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return rank

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = 1
        while width <= WIDE:
            low = width // 2
            for at in np.array_split(own := np.flatnonzero((sizes > low) & (sizes <= width)), len(own) * width // 2_000_000 + 1):
                if len(at):
                    self._encode_wide([words[i] for i in at], sizes[at], width, at, out)
            width *= 2
        for i in np.flatnonzero(sizes > WIDE):
            raw = np.frombuffer(words[i], np.uint8)
            symbols = self.first[raw].tolist()
            symbols[-1] = int(self.last[raw[-1]])
            out[i] = np.array(MergeTree(symbols, self.pairs, self.size).merged(), "<u4").tobytes()
        return out

    def _encode_wide(self, words: list[bytes], sizes: np.ndarray, width: int, at: np.ndarray, out: list[bytes]) -> None:
        n, w = len(words), width + 1  # one column more stands for "no symbol"
        sym = np.full((n, w), -1, np.int32)
        inside = np.arange(w) < sizes[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym[inside] = self.first[raw]
        sym[np.arange(n), sizes - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        after = np.tile(np.arange(1, w + 1, dtype=np.int32), (n, 1))
        after[np.arange(n), sizes - 1] = width
        after[:, width] = width
        before = np.tile(np.arange(-1, w - 1, dtype=np.int32), (n, 1))
        before[:, 0] = width
        shift = width.bit_length()
        tree = np.full((n, 2 * width), NONE, np.int32)
        if width > 1:
            rank = self.rank_of(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
            tree[:, width:] = np.where(rank != NONE, rank << shift | np.arange(width, dtype=np.int32), NONE)
            step = width // 2
            while step:
                tree[:, step : 2 * step] = np.minimum(tree[:, 2 * step : 4 * step : 2], tree[:, 2 * step + 1 : 4 * step : 2])
                step //= 2
        flat, nxt, prv, trees = sym.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        rows = np.flatnonzero(tree[:, 1 if width > 1 else 0] != NONE)
        while len(rows):
            base, root = rows * w, rows * (2 * width)
            top = trees[root + 1]
            i = (top & ((1 << shift) - 1)).astype(np.int64)
            j = nxt[base + i]
            k = nxt[base + j]
            h = prv[base + i]
            new = self.made[top >> shift]
            flat[base + i], flat[base + j] = new, -1
            nxt[base + i], prv[base + k] = k, i
            right = self.rank_of(new, flat[base + k])
            left = self.rank_of(flat[base + h], new)
            trees[root + width + j] = NONE
            trees[root + width + i] = np.where(right != NONE, right << shift | i, NONE)
            real = np.flatnonzero(h != width)
            trees[root[real] + width + h[real]] = np.where(left[real] != NONE, left[real] << shift | h[real], NONE)
            paths = np.concatenate([i, j, np.where(h != width, h, i)]).astype(np.int64) + width
            roots = np.concatenate([root, root, root])
            while True:
                paths >>= 1
                if not paths[0]:
                    break
                trees[roots + paths] = np.minimum(trees[roots + 2 * paths], trees[roots + 2 * paths + 1])
            rows = rows[trees[root + 1] != NONE]
        alive = sym >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        joined = sym[alive].astype("<u4").tobytes()
        start = 0
        for place, end in zip(at.tolist(), ends.tolist(), strict=True):
            out[place] = joined[start:end]
            start = end


#: First bytes of white space in UTF-8, ASCII and beyond.
SPACES = np.isin(np.arange(256), [*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3])


def starts_with_space(column: pa.Array, strings: list[str]) -> np.ndarray:
    """Which strings are empty or begin with white space: the first byte tells of most that they don't."""
    if not len(column):
        return np.zeros(0, bool)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    out = (ends[1:] == ends[:-1]) | SPACES[raw[np.minimum(ends[:-1], len(raw) - 1)]]
    for k in np.flatnonzero(out).tolist():
        out[k] = not strings[k] or strings[k][0].isspace()
    return out


class Memory:
    """Ids of pieces that were encoded before, one behind the other in an array; ``at`` has a piece's number in the order of coming."""

    def __init__(self):
        self.at: dict = {}
        self.starts, self.ids = np.zeros(2, np.int64), np.zeros(1 << 16, np.uint32)

    def put(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.at), int(self.starts[len(self.at)])
        if n + len(pieces) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + len(pieces) + 1))
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        self.ids[used : used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def fit(self, more: int) -> bool:
        """Makes room: of more than REMEMBERED pieces the later half goes, as what came first comes often. Whether any went."""
        if len(self.at) + more <= REMEMBERED:
            return False
        for piece in list(self.at)[REMEMBERED // 2 :]:
            del self.at[piece]
        return True


class Codec:
    """Encodes and decodes whole texts; remembers the ids of pieces of text that come again.

    A text is cut where no pre-token can cross: at ASCII white space if the vocabulary drops white space, else before
    single spaces between other characters. Only pieces that aren't remembered are encoded, by the segment trees, or
    with ``library`` by the tokenizers library as a whole.
    """

    def __init__(self, model: BpeModel, library: str | None = None):
        self.model = model
        self.known = Memory()  # pieces; in the second kind of vocabulary, those behind a space
        self.heads = Memory()  # what stands before the first cut there
        self.decimals = list(map(str, range(model.size)))
        # not at a white space character, in the wide sense, on either side
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])") if not model.suffix else None
        self.library = None
        if library:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core only
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(library)
            self.library.no_truncation()
            self.library.no_padding()
            mark = byte_alphabet()[0x20]
            # a token that ends a word, or that starts with a space
            self.edge = np.array([t.endswith(model.suffix) if model.suffix else t.startswith(mark) for t in model.tokens])

    def learn(self, pieces: Iterable, store: Memory, lead: str = "") -> None:
        """Remembers all of the pieces (not empty ones, and behind a space none that start with white space)."""
        self.put_new(list(set(pieces).difference(store.at)), store, lead)

    def numbers(self, pieces: list, store: Memory, lead: str = "") -> np.ndarray:
        """Where the store has distinct pieces, those that it hasn't yet being learned. One look at each."""
        at = np.fromiter(map(store.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        if missing and store.fit(len(missing)):
            at = np.fromiter(map(store.at.get, pieces, repeat(-1)), np.int64, len(pieces))
            missing = np.flatnonzero(at < 0).tolist()
        new = [pieces[k] for k in missing]
        self.put_new(new, store, lead, False)
        at[missing] = np.fromiter(map(store.at.__getitem__, new), np.int64, len(new))
        return at

    def put_new(self, new: list, store: Memory, lead: str, fit: bool = True) -> None:
        """Encodes distinct pieces that the store hasn't."""
        if fit and store.fit(len(new)):
            new = [p for p in new if p not in store.at]
        if not new:
            return
        if self.cut is None:
            texts = b"\n".join(new).decode().split("\n")  # pieces without white space stay apart
        else:
            texts = [lead + p for p in new] if lead else new
        if self.library:
            for part, ids, sizes in self.by_library(texts, bool(lead)):
                store.put([new[k] for k in part], ids, sizes)
            return
        split = self.model.split_many(texts)
        words = list({w for parts in split for w in parts})
        plain = [w.encode() if isinstance(w, str) else b"" for w in words]
        ids = {w: x if isinstance(w, str) else w.to_bytes(4, "little") for w, x in zip(words, self.model.encode_words(plain), strict=True)}
        found = [b"".join(map(ids.__getitem__, parts)) for parts in split]
        store.put(new, np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def by_library(self, texts: list[str], spaced: bool) -> Iterator[tuple[Iterable[int], np.ndarray, np.ndarray]]:
        """Ids of pieces by the tokenizers library: indexes of some, their ids in a row, and their numbers of ids.

        Many pieces make one text; its tokens that begin with a space, or end a word, tell them apart. Where their number
        isn't that of the pieces, such as for pieces of several words, each piece is a text of its own.
        """
        if self.cut is None:
            # a run of letters is one word, and one more with a mark behind it
            words = [1 if t.isalpha() else 2 if t[-1:] in MARKS and t[:-1].isalpha() else 0 for t in texts]
            together, alone = [k for k, n in enumerate(words) if n], [k for k, n in enumerate(words) if not n]
        else:
            words = [1] * len(texts)
            together, alone = (range(len(texts)), []) if spaced else ([], range(len(texts)))
        glue = "" if self.cut else " "
        for start in range(0, len(together), TOGETHER):
            part = together[start : start + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([glue.join([texts[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            edges, ends = np.flatnonzero(self.edge[ids]), np.cumsum([words[k] for k in part])
            if len(edges) != ends[-1] or (self.cut and edges[0]):
                alone = [*alone, *part]
            else:
                yield part, ids, np.diff(np.append(edges, len(ids)) if self.cut else np.append(0, edges[ends - 1] + 1))
        if alone:
            each = [e.ids for e in self.library.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            yield alone, np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text with runs of white space: cut between other characters only."""
        head, *parts = self.cut.split(text)
        self.learn([head], self.heads)
        self.learn(parts, self.known, " ")
        at = self.heads.at[head]
        out = [self.heads.ids[self.heads.starts[at] : self.heads.starts[at + 1]]]
        out += [self.known.ids[self.known.starts[k] : self.known.starts[k + 1]] for k in map(self.known.at.__getitem__, parts)]
        return np.concatenate(out)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and where each text's begin, with the end of the last.

        Arrow splits the texts and numbers their distinct pieces; only these are looked up one by one.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.ascii_split_whitespace(texts) if self.cut is None else pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).copy()
        if self.cut is None:
            own = coded.dictionary.cast(pa.binary()).to_pylist()
            number = self.numbers(own, self.known)
            table, starts, ends = self.known.ids, self.known.starts[number], self.known.starts[number + 1]
        else:
            pieces, heads = coded.dictionary.to_pylist(), lists.values.take(pa.array(offsets[:-1])).to_pylist()
            odd = starts_with_space(coded.dictionary, pieces)
            self.learn(heads, self.heads)
            first = np.fromiter(map(self.heads.at.__getitem__, heads), np.int64, len(heads))
            more = [self.heads.ids[low:high] for low, high in zip(self.heads.starts[first].tolist(), self.heads.starts[first + 1].tolist(), strict=True)]
            code[offsets[:-1]] = len(pieces) + np.arange(len(first))
            if odd.any():
                strange = np.append(odd, np.zeros(len(first), bool))
                for k in np.flatnonzero(np.add.reduceat(strange[code], offsets[:-1])).tolist():
                    more[k] = self.whole(texts[k].as_py())
                    code[offsets[k] + 1 : offsets[k + 1]] = len(pieces) + len(first)  # nothing more
            sound = list(compress(pieces, (~odd).tolist())) if odd.any() else pieces
            number = np.zeros(len(pieces), np.int64)
            number[~odd] = self.numbers(sound, self.known, " ")
            used, sizes = int(self.known.starts[len(self.known.at)]), np.array([*map(len, more), 0], np.int64)
            behind = used + np.cumsum(sizes)
            table = np.concatenate([self.known.ids[:used], *more])
            starts, ends = np.append(self.known.starts[number], behind - sizes), np.append(self.known.starts[number + 1], behind)
        n = (ends - starts)[code]
        total = np.cumsum(n)
        at = np.repeat((starts[code] - (total - n)).astype(np.int32), n)  # a slice has few enough ids
        at += np.arange(len(at), dtype=np.int32)
        return table[at], np.append(0, total)[offsets]

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_flat(), with a further id behind each text."""
        ids, bounds = self.encode_flat(texts)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[low:high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; those outside the vocabulary have none."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if ids and not 0 <= min(ids) <= max(ids) < self.model.size:
            ids = [i for i in ids if 0 <= i < self.model.size]
        if self.model.byte_decoder:
            return b"".join(map(self.model.token_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return " ".join(map(self.model.tokens.__getitem__, ids))


def shared_codec(path: str, library: bool = False) -> Codec:
    """The worker process's codec: later tasks of the process find the vocabulary read and frequent pieces known."""
    return held_by_worker(("codec", path, library), lambda: Codec(BpeModel(path), path if library else None))


def kept_schema(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in more}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, t) for n, t in more)])


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` (array of int), the ids of each whole text without added special tokens.

    A null or empty text gets an empty array. Repeated rows stay. A column that is named as the new one is replaced.
    The tokenizer's file is read on the executors: it has to be at the same path there.
    """
    schema = kept_schema(df, (ids_col, T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer_path)
        for batch in slices(batches, text_col):
            ids, bounds = codec.encode_flat(batch.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists if n == ids_col else batch.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``, the text of each array of ids, special tokens included. A null array and null ids give no text (empty)."""
    schema = kept_schema(df, (text_col, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer_path)
        for batch in batches:
            texts = pa.array([codec.decode([i for i in ids or () if i is not None]) for ids in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, decodes the ids, and gives digests of both: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    One pass: ids and decoded texts never leave the Python worker. Null and empty texts have no tokens and the digests of
    the empty string; null ids and repeated rows are kept as they are; other columns are dropped.
    """
    from hashlib import sha256

    df = df.select(id_col, text_col)
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer_path)
        decimals = codec.decimals.__getitem__
        for batch in slices(batches, text_col):
            n, ids_sha, text_sha = [], [], []
            flat, bounds = codec.encode_flat(batch.column(text_col))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = flat[low:high]
                n.append(len(ids))
                ids_sha.append(sha256(" ".join(map(decimals, ids.tolist())).encode()).hexdigest())
                text_sha.append(sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema.names)

    return df.mapInArrow(run, schema)
