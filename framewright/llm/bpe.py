"""Operator 8: byte-level BPE by a tokenization automaton.

Automaton. A state is the start or one token (the arc taken last); arcs are tokens. It begins as one state with an arc for each
byte. The merges are compiled in order, one gadget each: gadget k of u v -> uv cuts the arc v behind u, lets every state that has the
arc u have the arc uv, and makes the state behind uv a copy of the state behind v. What is left accepts exactly one token sequence for
each word, the one that BPE gives, and one for each prefix of it.

Table. Written out, the 50,000 gadgets of a usual vocabulary cut 70 million arcs. Two facts keep the table small and complete:
* Arcs are numbered so that v and all tokens that gadgets from k on make by extending v at its right are neighbours. What a gadget
  takes from a state, now and later, is therefore one interval of arcs: the table has one row (state, first, last, gadget) for each merge.
* A copied state keeps no copy of its rows: it has a default transition to the state behind v, which counts for the gadgets before k.
An arc is looked up by one binary search among the state's intervals, then along its default transitions.

Encoding. A hash table of byte transitions (the tokens' prefix tree) gives the tokens that begin at each byte of a word. Each prefix of the
word has one state: the only token ending there that the state at its start has an arc for. All new words of a slice of text advance
together, one byte a step; nothing is tried twice. Decoding emits the arcs' labels (the tokens' bytes).

Text is split into words as the vocabulary's tokenizer does it, by comparing the classes of neighbouring characters of a whole
slice at once. Equal words of a slice are encoded once, and each worker keeps a bounded table of the words it has met.

Defined cases. A null text counts as empty: no tokens, the hash of the empty string. An added token's string in a text becomes its
id, as in the library. Null ids in a list of ids and ids that the vocabulary lacks decode to nothing; a null list decodes to the empty
text. Rows are independent: repeated or null ids of documents, empty tables and other columns of any name do no harm (`encode`
puts its `ids` in the place of a column of that name, `decode` its `decoded`). Texts of any length are taken slice by slice, cut where a word
is sure to begin; a single word of n bytes is in one slice and takes n steps. Nothing is shuffled. A file of another kind (other model, other splitting, bytes without a token, two merges
that make one token) or of over `MAX_FILE_BYTES`, since it is broadcast, is refused by name.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Two-letter and one-letter ends that an apostrophe takes with it when byte-level vocabularies are split into words.
LONG_ENDS, SHORT_ENDS = ("re", "ve", "ll"), "stmd"
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters that are split at once: a worker's memory follows this.
SLICE = 1 << 20
#: Answers about arcs that a worker keeps: a power of two.
ASKED_BITS = 18
#: A vocabulary file is sent to the executors; larger files are refused.
MAX_FILE_BYTES = 64 << 20
NEVER, NONE = 1 << 60, -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, by rule: printable Latin-1 stays, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def check_kind(data: dict) -> None:
    """Raises ValueError unless the file is a plain byte-level BPE."""
    model, split = data["model"], data.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or data.get("normalizer") or odd:
        raise ValueError(f"not a plain BPE model: {odd or model.get('type')}")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("words are not split as in byte-level vocabularies")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", [])):
        raise ValueError("added tokens that strip or want whole words")


class Automaton:
    """The compiled table: byte transitions, cut intervals and default transitions of every state."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """`labels` are the bytes of the tokens, `merges` the gadgets (u, v, uv) in order."""
        size = max(labels) + 1
        self.labels = labels
        self.born = np.zeros(size, np.int64)
        self.default = np.full(size, NONE, np.int64)
        left: dict[int, int] = {}
        for number, (u, v, w) in enumerate(merges, 1):
            if w in left:
                raise ValueError(f"two merges make token {w}")
            self.born[w], self.default[w], left[w] = number, v, u
        sizes = np.ones(size, np.int64)
        for _, _, w in reversed(merges):
            sizes[left[w]] += sizes[w]
        bytes_only = [t for t in labels if t not in left and len(labels[t]) == 1]
        if {labels[t] for t in bytes_only} != {bytes([b]) for b in range(256)}:
            raise ValueError("some bytes have no token")
        self.place = np.full(size, -1, np.int64)
        room, live, at = np.zeros(size, np.int64), set(bytes_only), 0
        for t in bytes_only:
            room[t], at = at, at + sizes[t]
            self.place[t] = at - 1
        self.rows: dict[int, list[tuple[int, int, int]]] = {}
        for number, (u, v, w) in enumerate(merges, 1):
            if u in live and v in live and not self._is_cut(u, v):
                insort(self.rows.setdefault(u, []), (int(room[v]), int(self.place[v]), number))
                live.add(w)
            first = room[u]
            room[u] += sizes[w]
            room[w], self.place[w] = first, first + sizes[w] - 1
        rows = sorted((state, *row) for state, own in self.rows.items() for row in own)
        self.cut_state, first, self.cut_last, self.cut_number = np.array(rows, np.int64).reshape(-1, 4).T.copy()
        del self.rows
        self.width = at
        self.cut_key = self.cut_state * self.width + first
        self._byte_transitions({labels[t]: t for t in live})

    def _is_cut(self, state: int, arc: int) -> bool:
        """Whether the gadgets so far have taken the arc from the state."""
        place, limit = int(self.place[arc]), NEVER
        while state != NONE:
            own = self.rows.get(state, [])
            i = bisect_right(own, (place, NEVER, NEVER)) - 1
            if i >= 0 and place <= own[i][1] and own[i][2] < limit:
                return True
            limit, state = int(self.born[state]), int(self.default[state])
        return False

    def _byte_transitions(self, tokens: dict[bytes, int]) -> None:
        prefixes = {label[:n] for label in tokens for n in range(len(label))}
        nodes = {p: i for i, p in enumerate(sorted(prefixes))}
        self.inner = len(nodes)  # nodes that longer tokens pass; the others have no row
        for label in sorted(tokens):
            nodes.setdefault(label, len(nodes))
        found = [(nodes[label[:-1]] << 8 | label[-1], node) for label, node in nodes.items() if label]
        self._spread_out(*np.array(found, np.int32).T)
        self.token_at = np.full(len(nodes), NONE, np.int32)
        for label, token in tokens.items():
            self.token_at[nodes[label]] = token
        self.asked_key, self.asked = np.full(1 << ASKED_BITS, -1, np.int64), np.zeros(1 << ASKED_BITS, bool)

    def _spread_out(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """The transitions (node and byte, to node) as a table with at least as many free places as entries, by hash and next free place."""
        self.bits = int(2 * len(keys)).bit_length()
        self.key_at, self.next_at = np.full(1 << self.bits, NONE, np.int32), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.key_at[slot] == NONE)
            self.key_at[slot[free]] = keys[free]  # of several for one place the last stays
            mine = self.key_at[slot] == keys
            self.next_at[slot[mine]] = targets[mine]
            keys, targets, slot = keys[~mine], targets[~mine], slot[~mine] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int32)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Where transitions lead; NONE where there are none."""
        slot = self._slot(keys)
        met = self.key_at[slot]
        out = np.where(met == keys, self.next_at[slot], NONE)
        on = np.flatnonzero((met != keys) & (met != NONE))
        while len(on):
            slot[on] = slot[on] + 1 & (1 << self.bits) - 1
            met = self.key_at[slot[on]]
            out[on] = np.where(met == keys[on], self.next_at[slot[on]], NONE)
            on = on[(met != keys[on]) & (met != NONE)]
        return out

    def cut(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Which of the arcs their states do not have; answers are kept in a table of fixed size."""
        key = state.astype(np.int64) * self.width + self.place[arc]
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ASKED_BITS)).view(np.int64)
        out = self.asked[slot]
        new = np.flatnonzero(self.asked_key[slot] != key)
        if len(new):
            out[new] = self._look_up(state[new].astype(np.int64), self.place[arc[new]])
            self.asked_key[slot[new]], self.asked[slot[new]] = key[new], out[new]
            again = np.flatnonzero(self.asked_key[slot[new]] != key[new])  # two new keys of one slot: both keep their own answers
            self.asked_key[slot[new[again]]] = -1
        return out

    def _look_up(self, state: np.ndarray, place: np.ndarray) -> np.ndarray:
        limit, out, lane = np.full(len(place), NEVER), np.zeros(len(place), bool), np.arange(len(place))
        while len(lane) and len(self.cut_key):
            key = state * self.width + place
            row = np.maximum(np.searchsorted(self.cut_key, key, "right") - 1, 0)
            hit = (self.cut_state[row] == state) & (self.cut_key[row] <= key) & (place <= self.cut_last[row]) & (self.cut_number[row] < limit)
            out[lane[hit]] = True
            go = ~hit & (self.default[state] != NONE)
            lane, place, limit, state = lane[go], place[go], self.born[state[go]], self.default[state[go]]
        return out

    def _tokens_in(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and token of every occurrence of a token that ends by its start's stop."""
        lane = np.arange(len(data), dtype=np.int32)
        at, node, found = lane, np.zeros(len(data), np.int32), []
        while len(lane):
            node = self._next((node << 8) + data[at])
            on = np.flatnonzero(node != NONE)
            lane, at, node = lane[on], at[on] + 1, node[on]
            token = self.token_at[node]
            is_token = np.flatnonzero(token != NONE)
            found.append((lane[is_token], at[is_token], token[is_token]))
            inside = np.flatnonzero((at < stops[lane]) & (node < self.inner))
            lane, at, node = lane[inside], at[inside], node[inside]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def walk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The accepted token sequences of the (non-empty) words that end in `data` at `ends`, in a row, and where each one ends."""
        if not len(ends):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begins = np.append(0, ends[:-1]).astype(np.int32)
        ends = ends.astype(np.int32)
        word = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)
        start, end, token = self._tokens_in(data.astype(np.int32), ends[word])
        own = word[start]
        step = end - begins[own]
        order = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
        token, own, step = token[order], own[order], step[order]
        # a word of n bytes has n + 1 prefixes, so its prefixes lie one further on for each word before it
        source, target = start[order] + own, end[order] + own
        state, back = np.full(len(data) + len(ends), NONE, np.int32), np.zeros(len(data) + len(ends), np.int32)
        tokens = np.zeros(len(state), np.int32)
        edges = np.flatnonzero(np.diff(step, prepend=0, append=len(data) + 1))
        first = begins + np.arange(len(ends), dtype=np.int32)
        fresh = source == first[own]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            before = state[source[a:b]]
            good = fresh[a:b].copy()
            inner = np.flatnonzero(before != NONE)
            good[inner] = ~self.cut(before[inner], token[a:b][inner])
            good = np.flatnonzero(good) + a
            to, origin = target[good], source[good]
            state[to], back[to], tokens[to] = token[good], origin, tokens[origin] + 1
        at = ends + np.arange(len(ends), dtype=np.int32)
        bounds = np.cumsum(tokens[at], dtype=np.int64)
        ids, place = np.zeros(int(bounds[-1]), np.int32), bounds - 1
        while len(at):
            ids[place] = state[at]
            at = back[at]
            go = np.flatnonzero(at > first)
            at, first, place = at[go], first[go], place[go] - 1
        return ids, bounds


#: Letters and numbers that Unicode assigned after the version (16) by which the vocabulary's tokenizer splits.
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""


def kinds() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            out[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    for run in LATER.split():
        first, _, last = run.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = OTHER
    return out


def word_starts(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which characters begin a word; `first` marks those that begin a text."""
    kind = table[codes]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # the last white space before other text is a word, or, if it is a plain space, begins that text's word
    last = np.zeros(len(codes), bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    starts |= last
    starts[np.flatnonzero(last & (codes == 32)) + 1] = False
    marks = np.flatnonzero(starts & (codes == 39))
    if len(marks):
        limit = np.append(np.flatnonzero(first), len(codes))
        limit = limit[np.searchsorted(limit, marks, "right")]
        letters = np.append(codes, [0, 0])
        one, two = letters[marks + 1], letters[marks + 2]
        short = (marks + 1 < limit) & np.isin(one, [ord(c) for c in SHORT_ENDS])
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDS:
            long |= (marks + 2 < limit) & (one == ord(a)) & (two == ord(b))
        starts[marks[short | long] + 1] = False
        after = np.concatenate([marks[short] + 2, marks[long] + 3])
        starts[after[after < len(codes)]] = True
    return starts


class Coder:
    """Encoding and decoding with one vocabulary file; keeps the words it has met."""

    def __init__(self, source: str):
        data = json.loads(source)
        check_kind(data)
        alphabet, vocabulary = byte_alphabet(), data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        labels = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if token not in self.added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.automaton = Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.labels = labels | {i: s.encode() for s, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kinds = kinds()
        self.spelled = pa.array([self.labels.get(i, b"") for i in range(max(self.labels) + 1)] + [b""], pa.binary())
        self.written = pa.array([str(i).encode() for i in range(len(self.spelled))], pa.binary())
    def slices(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bool]]]:
        """The texts as (row, part, whether an added token), in lists of about SLICE characters."""
        held, size = [], 0
        for row, text in enumerate(texts):
            for i, part in enumerate(self.special.split(text) if text and self.special else [text or ""]):
                at = 0
                while i % 2 == 0 and len(part) - at > SLICE:
                    cut = self.boundary(part, at + SLICE)
                    if cut is None:
                        break
                    yield [*held, (row, part[at:cut], False)]
                    held, size, at = [], 0, cut
                if held and size + len(part) - at > SLICE:
                    yield held
                    held, size = [], 0
                held.append((row, part[at:], i % 2 == 1))
                size += len(part) - at
        if held:
            yield held

    def boundary(self, text: str, start: int) -> int | None:
        """The first place from `start` on that begins a word whatever stands around it.

        That is where white space follows other text, or where the class changes between other characters, but for what follows an apostrophe.
        """
        for low in range(start, len(text), SLICE // 16):
            codes = np.frombuffer(text[low - 1 : low + SLICE // 16].encode("utf-32-le"), np.uint32)
            kind = self.kinds[codes]
            sure = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & ((codes[:-1] != 39) | (kind[1:] == SPACE))
            if sure.any():
                return low + int(sure.argmax())
        return None

    def split(self, parts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """How many words each part has; the number of each word among the distinct words; those."""
        text = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        if not text:
            return np.zeros(len(parts), np.int64), pa.array([], pa.int32()), pa.array([], pa.binary())
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(codes), bool)
        first[begins[sizes > 0]] = True
        at = np.flatnonzero(word_starts(codes, first, self.kinds))
        data = text.encode()
        if len(data) == len(codes):
            edges = at
        else:
            widths = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            edges = (np.cumsum(widths, dtype=np.int64) - widths)[at]
        offsets = np.append(edges, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        counts = np.searchsorted(at, begins + sizes) - np.searchsorted(at, begins)
        return counts, words.indices, words.dictionary

    def code(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, pa.Array, pa.Array, np.ndarray]]:
        """For each slice: the row of each part, its number of words, the words' numbers among the distinct ones, the ids of those in a row
        and where each one's begin (and the last one's end)."""
        for held in self.slices(texts):
            counts, words, distinct = self.split(["" if added else part for _, part, added in held])
            buffers = distinct.buffers()
            bounds = np.frombuffer(buffers[1], np.int32)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int32)
            data = np.frombuffer(buffers[2], np.uint8)[: bounds[-1]] if len(distinct) else np.zeros(0, np.uint8)
            ids, ends = self.automaton.walk(data, bounds[1:])
            added = np.array([i for i, h in enumerate(held) if h[2]], np.int64)
            if len(added):  # words of one token each, behind the others
                words = pa.array(np.insert(words.to_numpy(), (np.cumsum(counts) - counts)[added], len(distinct) + np.arange(len(added))))
                counts[added] = 1
                ids = np.append(ids, np.array([self.added[held[i][1]] for i in added.tolist()], np.int32))
                ends = np.append(ends, (ends[-1] if len(ends) else 0) + 1 + np.arange(len(added)))
            yield [h[0] for h in held], counts, words, pa.array(ids), np.append(0, ends)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of every text."""
        sizes, flat = np.zeros(len(texts), np.int64), [pa.array([], pa.int32())]
        for rows, counts, words, ids, bounds in self.code(texts):
            np.add.at(sizes, rows, per_part(np.diff(bounds), words, counts))
            flat.append(pa.ListArray.from_arrays(bounds.astype(np.int32), ids).take(words).flatten())
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.concat_arrays(flat))

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The arc labels of every list of ids."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        last = len(self.spelled) - 1
        return joined(self.spelled.take(pa.array(np.where((flat >= 0) & (flat < last), flat, last))), sizes, b"").to_pylist()

    def digest(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, SHA-256 of the comma-joined ids and of the decoded text of every text."""
        totals = [0] * len(texts)
        ids_hash, text_hash = [[hashlib.sha256() for _ in texts] for _ in range(2)]
        for rows, counts, words, ids, bounds in self.code(texts):
            lengths = np.diff(bounds)
            written = joined(joined(self.written.take(ids), lengths, b",").take(words), counts, b",")
            spelled = joined(joined(self.spelled.take(ids), lengths, b"").take(words), counts, b"")
            for row, n, coded, text in zip(rows, per_part(lengths, words, counts).tolist(), written.to_pylist(), spelled.to_pylist(), strict=True):
                if n and totals[row]:
                    ids_hash[row].update(b",")
                ids_hash[row].update(coded)
                text_hash[row].update(text)
                totals[row] += n
        return totals, [h.hexdigest() for h in ids_hash], [h.hexdigest() for h in text_hash]


def per_part(lengths: np.ndarray, words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The number of ids of each part, from those of its words."""
    sums = np.append(0, np.cumsum(lengths[words.to_numpy()], dtype=np.int64))
    return np.diff(sums[np.append(0, np.cumsum(counts))])


def joined(values: pa.Array, counts: np.ndarray, between: bytes) -> pa.Array:
    """Groups of neighbouring values, joined."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), between)


_loaded: dict[str, Coder] = {}


def _coder(source: tuple) -> Coder:
    """The worker's coder: compiled once for each vocabulary."""
    key, text = source
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Coder(text.value)
    return _loaded[key]


def _vocabulary(docs: DataFrame, path: str) -> tuple:
    """The hash of the vocabulary file and the file, of checked size and kind, as a broadcast."""
    file = Path(path)
    if file.stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {MAX_FILE_BYTES} bytes")
    text = file.read_text(encoding="utf-8")
    try:
        check_kind(json.loads(text))
    except ValueError as odd:
        raise ValueError(f"{path}: {odd}") from odd
    return hashlib.sha256(text.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(text)


def _with(frame: DataFrame, read: str, name: str, kind: T.DataType, values) -> DataFrame:
    """All columns of `frame` but `name`, and `name`: `values(batch's column read)` of each Arrow batch."""
    others = [c for c in frame.columns if c.lower() != name]
    rows = frame.select(*[frame[c] for c in others], frame[read].alias("\x00read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values(batch.columns[-1])], [*others, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns and `ids` (array<int>, in the place of a column of that name): the token ids of each whole text."""
    source = _vocabulary(docs, path)
    return _with(docs, text_col, "ids", T.ArrayType(T.IntegerType()), lambda texts: _coder(source).encode(texts.to_pylist()))


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and `decoded` (in the place of a column of that name): the texts that the ids spell."""
    source = _vocabulary(coded, path)
    return _with(coded, ids_col, "decoded", T.StringType(), lambda ids: pa.array([b.decode("utf-8", "replace") for b in _coder(source).decode(ids)], pa.string()))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest: doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    source, names = _vocabulary(docs, path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, texts = _coder(source).digest(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
