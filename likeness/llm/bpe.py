"""Word-level byte-pair encoding: an exact splitter into words, a cached encoder and a transducer.

``Words`` normalises texts and splits them as the tokenizer file says, in numpy over whole batches.
``Encoder`` gives ids: every distinct word is encoded once by the library's own BPE model and kept
in a bounded cache. ``Transducer`` gives counts: the vocabulary compiled to a deterministic
finite-state transducer whose transitions carry emitted-token counts.

Words with code points outside the splitter's alphabet (whose normal form or class may differ between
Unicode versions) go to the ``tokenizers`` library, one stretch between ASCII white space at a time;
texts with special strings go there whole. So every result is the library's.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .words import IntTable, mix, span_hashes

END = 256
#: Symbols of a chunk; the chunks of a stream are read side by side.
CHUNK = 64
#: Symbols read at once; a longer stream goes on from the state that the part before left.
SEGMENT = 1 << 19
#: Compiled transitions kept by one worker; beyond it the transducer is compiled anew as needed.
MOST_TRANSITIONS = 1_000_000
#: Distinct words whose result one worker keeps; beyond it the table starts anew.
MOST_WORDS = 1_500_000

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_UNSAFE = re.compile(
    "<\\||[İΣ֐-᷿ἀ-῿Ⰰ-⿿㄀-ㄯ㄰-㆏ㆠ-㏿ꀀ-꯿힤-\U0010ffff]"
)
_STRETCH = re.compile("[^\t-\r ]+")
#: Tells a stretch for the library from a word of the same bytes.
_RAW_MARK = np.int64(0x2A65B1D3C97F4E81)
#: A text of these bytes only has no unsafe code point.
_PLAIN_BYTES = bytes(b for b in range(256) if b not in (0xC4, 0xCE) and b < 0xD6)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    for cp in range(0x10000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    #: The code points with the White_Space property.
    for cp in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[cp] = SPACE
    return out


class Words:
    """Splits texts into the tokenizer's words and knows each distinct word by a 63-bit hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = json.loads(self.library.to_str())["model"]
        if self.model["type"] != "BPE" or self.model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a word-level BPE file with the end mark </w> is needed")
        self.letters = _byte_letters()
        self.classes = _classes()

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each word of normalised UTF-8 bytes."""
        n = len(data)
        kind = self.classes[data]
        head = np.ones(n, bool)  # first byte of a code point
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            head[(data >= 0x80) & (data < 0xC0)] = False
            b = data[wide].astype(np.int32)
            two = wide[b < 0xE0]
            cp = ((data[two].astype(np.int32) & 0x1F) << 6) | (data[two + 1] & 0x3F)
            kind[two] = kind[two + 1] = self.classes[cp]
            three = wide[b >= 0xE0]
            cp = ((data[three].astype(np.int32) & 0x0F) << 12) | ((data[three + 1].astype(np.int32) & 0x3F) << 6) | (data[three + 2] & 0x3F)
            kind[three] = kind[three + 1] = kind[three + 2] = self.classes[cp]
        before = np.empty(n, np.uint8)
        before[:1] = SPACE
        before[1:] = kind[:-1]
        start = ((kind != before) | ((kind == NUMBER) & head)) & (kind != SPACE)
        for i in np.flatnonzero((data == 0x27) & start).tolist():  # 's 't 're 've 'm 'll 'd
            tail = data[i + 1 : i + 3].tobytes()
            k = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if k:
                start[i + 1] = False
                if i + 1 + k < n and kind[i + 1 + k] != SPACE:
                    start[i + 1 + k] = True
        starts = np.flatnonzero(start)
        # a word ends where the next one starts or white space follows
        stop = start
        stop[1:] |= (kind[1:] == SPACE) & (kind[:-1] != SPACE)
        stops = np.append(np.flatnonzero(stop), n)
        ends = stops[1:][kind[stops[:-1]] != SPACE]
        return starts, ends

    @staticmethod
    def normal(text: str) -> tuple[bytes | None, list[tuple[int, int]]]:
        """(normalised bytes, spans in them that the library must read); None if it must read the whole text."""
        if "<|" in text:
            return None, []
        if not text.isascii():
            if text.encode().translate(None, _PLAIN_BYTES) and _UNSAFE.search(text):
                parts, spans, size, at = [], [], 0, 0
                for m in _STRETCH.finditer(text):
                    if _UNSAFE.search(m.group()):
                        before, raw = unicodedata.normalize("NFC", text[at : m.start()]).lower().encode(), m.group().encode()
                        spans.append((size + len(before), size + len(before) + len(raw)))
                        parts += [before, raw]
                        size, at = size + len(before) + len(raw), m.end()
                parts.append(unicodedata.normalize("NFC", text[at:]).lower().encode())
                return b"".join(parts), spans
            text = unicodedata.normalize("NFC", text)
        return text.lower().encode(), []

    def split(self, texts: list[str]):
        """(bytes, word starts, word ends, word keys, whether the library must read the word, text of each word, texts for the library)."""
        parts = [self.normal(t) for t in texts]
        own = [i for i, (p, _) in enumerate(parts) if p is None]
        data = np.frombuffer(b"\n".join([p or b"" for p, _ in parts]), np.uint8)
        sizes = np.array([len(p or b"") + 1 for p, _ in parts], np.int64)
        begins = np.cumsum(sizes) - sizes
        starts, ends = self.words(data)
        spans = [(int(begins[i]) + a, int(begins[i]) + b) for i, (_, each) in enumerate(parts) for a, b in each]
        raw = np.zeros(len(starts), bool)
        if spans:
            low, high = np.array(spans).T
            before = np.searchsorted(low, starts, side="right") - 1
            free = (before < 0) | (starts >= high[before])
            starts, ends = np.concatenate([starts[free], low]), np.concatenate([ends[free], high])
            order = np.argsort(starts, kind="stable")
            starts, ends, raw = starts[order], ends[order], order >= int(free.sum())
        keys = span_hashes(data, starts, ends)
        keys[raw] ^= _RAW_MARK
        each = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        return data, starts, ends, keys, raw, np.repeat(np.arange(len(texts)), each), own

    def library_ids(self, raw: bytes) -> list[int]:
        return self.library.encode(raw.decode(), add_special_tokens=False).ids


class Encoder(Words):
    """Token ids of whole texts."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        super().__init__(path)
        self.bpe = self.library.model
        self.most_words = most_words
        self._clear()

    def _clear(self) -> None:
        self.table = IntTable()
        self.begin, self.known = np.zeros(1, np.int64), 0  # where the ids of word k begin
        self.flat = np.zeros(1 << 16, np.uint32)

    def _ids_of(self, word: bytes, raw: bool) -> list[int]:
        if raw:
            return self.library_ids(word)
        plain = word.isascii() and word.decode().isprintable()
        return [t.id for t in self.bpe.tokenize(word.decode() if plain else "".join([self.letters[b] for b in word]))]

    def _learn(self, words: list[tuple[bytes, bool]], keys: np.ndarray) -> None:
        tokens = [self._ids_of(*w) for w in words]
        sizes = np.array([len(t) for t in tokens], np.int64)
        ids = np.array([i for t in tokens for i in t], np.uint32)
        base = int(self.begin[self.known])
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[base : base + len(ids)] = ids
        self.begin = np.concatenate([self.begin[: self.known + 1], base + np.cumsum(sizes)])
        self.table.insert(keys, np.arange(self.known, self.known + len(words), dtype=np.int32))
        self.known += len(words)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text as uint32 arrays."""
        data, starts, ends, keys, alone, word_text, own = self.split(texts)
        if len(starts):
            if self.known > self.most_words:
                self._clear()
            word, missing = self.table.find(keys)
            if len(missing):
                new, first = np.unique(keys[missing], return_index=True)
                raw = data.tobytes()
                at = missing[first]
                self._learn([(raw[a:b], r) for a, b, r in zip(starts[at].tolist(), ends[at].tolist(), alone[at].tolist(), strict=True)], new)
                word[missing], _ = self.table.find(keys[missing])
            n = self.begin[word + 1] - self.begin[word]
            done = np.cumsum(n)
            flat = self.flat[np.repeat(self.begin[word] - done + n, n) + np.arange(int(done[-1]))]
            sizes = np.bincount(word_text, n, len(texts)).astype(np.int64)
        else:
            flat, sizes = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        out = np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []
        for i in own:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


class Transducer(Words):
    """Token counts of whole texts by a compiled finite-state transducer.

    Reading a word byte by byte, the token that ends the encoding of each prefix is unique, and it
    depends on the longest suffix that begins some token (a node of the token trie) together with the
    last tokens at the suffix boundaries: that is the transducer's state. A transition carries the
    change of the token count. Transitions are compiled when a word first needs them, all that one
    step of the lanes needs at once. The counts of words met before are kept in a bounded table, so
    only words that are new to a worker are read.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        super().__init__(path)
        model, self.most_words, self.seen = self.model, most_words, IntTable()
        letter = {c: b for b, c in enumerate(self.letters)}
        vocab = model["vocab"]
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        for text, i in vocab.items():
            whole = text.endswith("</w>") and len(text) > 4
            body = text[:-4] if whole else text
            if any(c not in letter for c in body):
                continue  # a special string, never the outcome of merges
            seq = [letter[c] for c in body] + [END] * whole
            node = 0
            for c in seq:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        self.token_at = np.array(token_at, np.int32)
        n = max(vocab.values()) + 1
        # of each token the rank of its merge (-1: none), and its two parts
        self.made_rank, self.made_left, self.made_right = (np.full(n, -1, np.int64) for _ in range(3))
        rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            rank.setdefault(left << 24 | right, r)
            if self.made_rank[whole] < 0:
                self.made_rank[whole], self.made_left[whole], self.made_right[whole] = r, left, right
        self.rank = IntTable()
        self.rank.insert(np.array(list(rank), np.int64), np.array(list(rank.values()), np.int32))
        self._link(children)
        self._reset()

    def _link(self, children: list[dict[int, int]]) -> None:
        """Suffix links of the token trie, breadth first, and each node's chain of suffixes, shortest first."""
        n = len(children)
        fail, depth, chains = [0] * n, [0] * n, [()] * n
        row = list(children[0].values())
        for m in row:
            depth[m], chains[m] = 1, (m,)
        while row:
            below = []
            for node in row:
                for c, m in children[node].items():
                    depth[m] = depth[node] + 1
                    f = fail[node]
                    while f and c not in children[f]:
                        f = fail[f]
                    fail[m] = children[f].get(c, 0)
                    chains[m] = (*chains[fail[m]], m)
                    below.append(m)
            row = below
        self.fail, self.depth = np.array(fail), np.array(depth)
        self.chain_size = np.array([len(c) for c in chains])
        self.chain_begin = np.cumsum(self.chain_size) - self.chain_size
        self.chain = np.array([m for c in chains for m in c])
        keys = np.array([node * 257 + c for node, d in enumerate(children) for c in d], np.int64)
        self.edges = IntTable()
        self.edges.insert(keys, np.array([m for d in children for m in d.values()], np.int32))

    def _fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of token u followed by token t gives exactly [u, t].

        The merges are undone along the border, latest first; the border holds if at no stage
        the two tokens that face each other would have merged before the merge undone last.
        """
        key, back = np.unique(u.astype(np.int64) << 24 | t, return_inverse=True)
        known, missing = self.fit_table.find(key)
        if len(missing):
            left, right = key[missing] >> 24, key[missing] & 0xFFFFFF
            limit, good, todo = np.full(len(missing), 1 << 40), np.ones(len(missing), bool), np.arange(len(missing))
            while len(todo):
                rank, none = self.rank.find(left[todo] << 24 | right[todo])
                merges = rank < limit[todo]
                merges[none] = False
                good[todo[merges]] = False
                todo = todo[~merges]
                of_left, of_right = self.made_rank[left[todo]], self.made_rank[right[todo]]
                some = (of_left >= 0) | (of_right >= 0)
                todo, of_left, of_right = todo[some], of_left[some], of_right[some]
                later = of_left > of_right
                # of equal merges the left one comes first, so one across the border precedes the right one
                limit[todo] = np.where(later, of_left, of_right + 1)
                left[todo[later]] = self.made_right[left[todo[later]]]
                right[todo[~later]] = self.made_left[right[todo[~later]]]
            self.fit_table.insert(key[missing], good.astype(np.int32))
            known[missing] = good
        return known[back].astype(bool)

    # -- compilation on demand ------------------------------------------------------------------

    def _reset(self, keep: int = 0) -> int:
        """Forget all transitions; the new number of the state ``keep``."""
        kept = None
        if keep:
            at = slice(int(self.begin[keep]), int(self.begin[keep]) + int(self.chain_size[self.node[keep]]) + 1)
            kept = int(self.node[keep]), self.token[at].copy(), self.count[at].copy(), int(self.delta[keep])
        # state 0 is the start of a word: no token before it
        self.n_states, self.n_entries = 1, 1
        self.node, self.begin = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)
        self.delta, self.end_delta = np.zeros(1 << 12, np.int16), np.full(1 << 12, -32768, np.int16)
        self.token, self.count = np.full(1 << 14, -1, np.int32), np.zeros(1 << 14, np.int16)
        self.next, self.state_table, self.fit_table = IntTable(), IntTable(), IntTable()
        if kept is None:
            return 0
        node, token, count, delta = kept
        return int(self._interned(np.array([node]), token[:1], np.zeros(len(token) - 1, np.int64), token[1:], count[1:], np.array([delta]))[0])

    def _goto(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Node of the longest suffix that begins a token, after one more symbol."""
        n, out, todo = node.astype(np.int64), np.zeros(len(node), np.int64), np.arange(len(node))
        while len(todo):
            child, missing = self.edges.find(n[todo] * 257 + symbol[todo])
            hit = np.ones(len(todo), bool)
            hit[missing] = False
            out[todo[hit]] = child[hit]
            todo = todo[~hit]
            todo = todo[n[todo] > 0]
            n[todo] = self.fail[n[todo]]
        return out

    def _advance(self, state: np.ndarray, symbol: np.ndarray):
        """What reading one symbol leads to from each state.

        Returns (node, last token, owner, token, count, change): owner, token and count are the rows of
        the node's suffixes, shortest first; the counts are relative to the place after the symbol.
        """
        items = np.arange(len(state))
        old = self.node[state]
        size = self.chain_size[old] + 1
        owner, within = _spread(size)
        entry = self.begin[state][owner] + within
        depth = np.where(within > 0, self.depth[self.chain[np.maximum(self.chain_begin[old][owner] + within - 1, 0)]], 0)
        held = owner << 12 | depth
        node = self._goto(old, symbol)
        size = self.chain_size[node]
        if not size.all():
            raise ValueError(f"no token ends with symbol {symbol[size == 0][0]}")
        owner, within = _spread(size)
        suffix = self.chain[self.chain_begin[node][owner] + within]
        # what is known at the place where the suffix begins
        entry = entry[np.searchsorted(held, owner << 12 | (self.depth[suffix] - 1))]
        before, count, token = self.token[entry], self.count[entry].astype(np.int64), self.token_at[suffix]
        ends = token >= 0
        ask = np.flatnonzero(ends & (before >= 0))
        ends[ask] = self._fits(before[ask], token[ask])
        best = np.maximum.reduceat(np.where(ends, np.arange(len(ends)), -1), np.cumsum(size) - size)
        if (best < 0).any():
            raise ValueError(f"no token ends with symbol {symbol[best < 0][0]}")
        change = count[best] + 1
        return node, token[best], items[owner], before, count - change[owner], change

    def _interned(self, node, last, owner, token, count, change) -> np.ndarray:
        """Numbers of the states with these parts; new ones are added."""
        size = self.chain_size[node]
        begin = np.cumsum(size) - size
        place = np.arange(len(owner)) - begin[owner]
        rows = mix(mix(token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)) + count.astype(np.int64).astype(np.uint64))
        whole = mix(node.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)) + np.add.reduceat(rows, begin)
        key, first, back = np.unique((mix(whole) >> np.uint64(1)).astype(np.int64), return_index=True, return_inverse=True)
        number, missing = self.state_table.find(key)
        if len(missing):
            pick = first[missing]
            new = np.arange(self.n_states, self.n_states + len(pick))
            lengths = size[pick] + 1
            to = self.n_entries + np.cumsum(lengths) - lengths
            self._room(self.n_states + len(pick), self.n_entries + int(lengths.sum()))
            self.node[new], self.begin[new], self.delta[new] = node[pick], to, change[pick]
            self.token[to], self.count[to] = last[pick], 0
            of, within = _spread(size[pick])
            self.token[to[of] + 1 + within] = token[begin[pick][of] + within]
            self.count[to[of] + 1 + within] = count[begin[pick][of] + within]
            self.n_states += len(pick)
            self.n_entries += int(lengths.sum())
            self.state_table.insert(key[missing], new.astype(np.int32))
            number[missing] = new
        return number[back]

    def _room(self, states: int, entries: int) -> None:
        while states > len(self.node):
            for name, fill in (("node", 0), ("begin", 0), ("delta", 0), ("end_delta", -32768)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(len(old), fill, old.dtype)]))
        while entries > len(self.token):
            for name in ("token", "count"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(len(old), old.dtype)]))

    def _go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Targets of byte transitions; new ones are compiled."""
        keys = (state.astype(np.int64) << 8) | symbol
        out, missing = self.next.find(keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            to = self._interned(*self._advance(new >> 8, new & 255))
            self.next.insert(new, to)
            out[missing] = to[back]
        return out

    def _ends(self, state: np.ndarray) -> np.ndarray:
        """Changes of the count at the end of a word."""
        new = np.unique(state[self.end_delta[state] == -32768])
        if len(new):
            self.end_delta[new] = self._advance(new, np.full(len(new), END))[-1]
        return self.end_delta[state]

    def _run(self, stream: np.ndarray, entry: int) -> np.ndarray:
        """The state after each symbol (before END: the state that END leaves).

        The stream is cut into chunks that are read side by side, and each chunk's state map is known
        for the entry states met so far. After its first END a chunk is in the start state whatever
        came before, so from there on its map is constant: that part runs first. The rest is run from
        the exit of the chunk before where that is known, else from the start state. Then the maps are
        composed: every chunk takes the exit of the one before as its entry, and those whose map lacks
        it are run again, all side by side, until they are in the state of their earlier run at the same
        place, from where on both are equal. It ends when every chunk's map has its entry. Runs meet
        after a few tokens, so few rounds are needed, and the first chunk is right from the beginning.
        """
        n = len(stream)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint16)
        grid[:n] = stream
        grid = grid.reshape(rows, CHUNK)
        out = np.zeros((rows, CHUNK), np.int32)
        is_end = grid == END
        first = np.where(is_end.any(1), is_end.argmax(1), CHUNK)

        def side_by_side(lanes, begin, stop, state, again) -> tuple[np.ndarray, np.ndarray]:
            """Run each lane over [begin, stop); (exit states, lanes that did not meet their earlier run)."""
            state, apart = state.astype(np.int32), np.ones(len(lanes), bool)
            for j in range(int(begin.min()), int(stop.max())):
                on = np.flatnonzero(apart & (begin <= j) & (j < stop))
                c = grid[lanes[on], j]
                end = c == END
                out[lanes[on[end]], j] = state[on[end]]
                state[on[end]] = 0
                on = on[~end]
                to = self._go(state[on], c[~end])
                if again:
                    apart[on[out[lanes[on], j] == to]] = False
                out[lanes[on], j] = state[on] = to
            return state, apart

        exits, known = np.zeros(rows, np.int32), first < CHUNK
        body = np.flatnonzero(first < CHUNK - 1)
        if len(body):
            exits[body], _ = side_by_side(body, first[body] + 1, np.full(len(body), CHUNK), np.zeros(len(body)), False)
        taken, again = np.full(rows, -1, np.int32), False
        while True:
            entries = np.append(np.int32(entry), exits[:-1])
            lanes = np.flatnonzero(entries != taken)
            if not len(lanes):
                return out.reshape(-1)[:n]
            taken[lanes] = entries[lanes]
            left, apart = side_by_side(lanes, np.zeros(len(lanes), np.int64), np.minimum(first[lanes] + 1, CHUNK), entries[lanes], again)
            new = apart & ~known[lanes]
            exits[lanes[new]] = left[new]
            again = True

    def _counts_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each of these words, read as one stream in which END closes each word."""
        lengths = ends - starts
        word_end = np.cumsum(lengths + 1) - 1
        stream = np.full(int(word_end[-1]) + 1, END, np.uint16)
        inside = np.ones(len(stream), bool)
        inside[word_end] = False
        owner, within = _spread(lengths)
        stream[inside] = data[starts[owner] + within]
        change, entry = np.zeros(len(stream), np.int64), 0
        for at in range(0, len(stream), SEGMENT):
            if self.next.filled > MOST_TRANSITIONS:
                entry = self._reset(entry)
            part = stream[at : at + SEGMENT]
            state = self._run(part, entry)
            here = self.delta[state].astype(np.int64)
            done = np.flatnonzero(part == END)
            here[done] = self._ends(state[done])
            change[at : at + SEGMENT] = here
            entry = 0 if part[-1] == END else int(state[-1])
        return np.diff(np.cumsum(change)[word_end], prepend=0)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        data, starts, ends, keys, alone, word_text, own = self.split(texts)
        if len(starts):
            if self.seen.filled > self.most_words:
                self.seen = IntTable()
            n, missing = self.seen.find(keys)
            if len(missing):
                new, first = np.unique(keys[missing], return_index=True)
                at = missing[first]
                found, mine = np.zeros(len(new), np.int32), ~alone[at]
                if mine.any():
                    found[mine] = self._counts_of(data, starts[at[mine]], ends[at[mine]])
                found[~mine] = [len(self.library_ids(data[a:b].tobytes())) for a, b in zip(starts[at[~mine]].tolist(), ends[at[~mine]].tolist(), strict=True)]
                self.seen.insert(new, found)
                n[missing], _ = self.seen.find(keys[missing])
            out += np.bincount(word_text, n, len(texts)).astype(np.int64)
        for i in own:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) of the members of groups of these sizes."""
    done = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(int(done[-1]) if len(done) else 0) - (done - sizes)[owner]


_loaded: dict = {}


def loaded(kind: type, path: str):
    """The encoder or transducer of a tokenizer file, one for each worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
