"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding. A text is cut at its special tokens and by the pre-tokeniser's pattern; merges
never cross those cuts. Within a piece the transducer reads a window, applies the merge
list to it and emits the tokens that end at least ``lookahead`` bytes before the window's
end: no bytes to come can change them. It goes on from the last emitted token, since the
tokens of the rest are the same whether the text begins there or earlier. The window is
lookahead + ``CHUNK`` bytes, so a piece of any length takes constant memory.

Sufficient lookahead, from the merge list alone. Let R(t, i) be how many bytes beyond the
end of token t must be known to be sure that t exists just before rule i. Token t = (x, y)
is lost to a rule j < i that takes t as its left part, (t, d): then d must be known, len(d)
+ R(d, j) bytes; and t is formed only if its right part y wasn't taken before rule t, R(y,
rule of t). Rule numbers fall along either branch, so one pass over the rules in order
gives every R; the bound is the largest. What takes t's left part from the left needs no
byte beyond those.

Windows of a batch are merged together: in every step each window's best-ranked pair is
merged, in numpy over all of them, with the ranks in a hash table. Results of short pieces
are kept in a bounded cache.

Digests take a text's pieces in blocks, over the ends of texts, and keep no ids: beside the text there are a block of
pieces, the window of a long one, two digests and the decoder. Files with settings that this doesn't follow are refused.

Decoding is an incremental state machine from token bytes to text: it holds at most three
bytes of an unfinished character; bytes that form none become U+FFFD, one for each maximal
ill-formed part.

Defined results: null and empty texts have no tokens; a special token's string in a text is
that token; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import small_batches

#: Bytes of a window beyond the lookahead.
CHUNK = 256
#: Pieces of at most this many characters are kept in the cache of at most CACHE pieces.
CACHED_CHARS, CACHE = 48, 200_000
#: Pieces that are in memory at a time, and characters of a long piece that are read at a time.
PIECES, CHARS = 1 << 16, 4096
DEFAULT_FILE = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """Byte-level files write bytes as printable characters: those that are printable
    in Latin-1 stand for themselves, the others follow from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A merge list read from a tokenizer file, with its lookahead; see the module."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.token_bytes = {i: raw(s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        rules = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.lookahead = sufficient_lookahead(rules, {i: len(b) for i, b in self.token_bytes.items()})
        self._index(rules)
        #: Fixed value: the byte-level pre-tokeniser's published pattern.
        self.pieces = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def _index(self, rules: list[tuple[int, int, int]]) -> None:
        """An open-addressing table from pairs to (rank, merged token)."""
        self.bits = max(4, (4 * len(rules)).bit_length())
        size = 1 << self.bits
        keys, rank, out = np.full(size, -1, np.int64), np.full(size, np.iinfo(np.int32).max, np.int64), np.zeros(size, np.int64)
        first: dict[int, tuple[int, int]] = {}
        for r, (a, b, c) in enumerate(rules):
            first.setdefault(a << 32 | b, (r, c))
        todo_key = np.array(list(first), np.int64)
        todo = np.array(list(first.values()), np.int64).reshape(-1, 2)
        self.probes, at = 0, self._slot(todo_key)
        while len(todo_key):
            self.probes += 1
            free = keys[at] == -1
            keys[at[free]] = todo_key[free]  # of several for one slot the last stays
            placed = keys[at] == todo_key
            rank[at[placed]], out[at[placed]] = todo[placed, 0], todo[placed, 1]
            todo_key, todo, at = todo_key[~placed], todo[~placed], (at[~placed] + 1) & (size - 1)
        self.keys, self.rank, self.out = keys, rank, out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the largest int32 where no rule) and merged token of each pair."""
        key = left << 32 | right
        at = self._slot(key)
        rank, out = np.where(self.keys[at] == key, self.rank[at], np.iinfo(np.int32).max), self.out[at]
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = open_[there == key[open_]]
            rank[hit], out[hit] = self.rank[at[hit]], self.out[at[hit]]
            open_ = open_[(there != key[open_]) & (there != -1)]
        return rank, out

    def merge(self, windows: list[bytes]) -> list[list[int]]:
        """The tokens of each window. All windows take a step together: its best pair, leftmost first."""
        done: list[list[int] | None] = [None] * len(windows)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            by_size.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in by_size.items():
            step = max(1, (1 << 21) // width)
            for at in range(0, len(members), step):
                own = members[at : at + step]
                for i, tokens in zip(own, self._merge_block([windows[i] for i in own], width), strict=True):
                    done[i] = tokens
        return done

    def _merge_block(self, windows: list[bytes], width: int) -> list[list[int]]:
        none = np.iinfo(np.int32).max
        n = np.fromiter(map(len, windows), np.int64, len(windows))
        tokens = np.full((len(windows), width + 1), -1, np.int64)
        tokens[np.arange(width + 1) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(windows), np.uint8)]
        rank, out = np.full(tokens.shape, none, np.int64), np.zeros(tokens.shape, np.int64)
        real = np.flatnonzero((np.arange(width + 1) < (n - 1)[:, None]).ravel())
        flat = tokens.ravel()
        rank.ravel()[real], out.ravel()[real] = self._find(flat[real], flat[real + 1])
        result: list[list[int] | None] = [None] * len(windows)
        row = np.arange(len(windows))
        while len(row):
            best = rank.argmin(axis=1)
            k = np.arange(len(row))
            merging = rank[k, best] < none
            if not merging.all():
                ended = np.flatnonzero(~merging)
                for r, i, m in zip(row[ended].tolist(), ended.tolist(), n[ended].tolist(), strict=True):
                    result[r] = tokens[i, :m].tolist()
                tokens, rank, out, row, n, best = tokens[merging], rank[merging], out[merging], row[merging], n[merging], best[merging]
                k = np.arange(len(row))
            if not len(row):
                break
            tokens[k, best] = out[k, best]
            # what stands right of the merged pair moves one place to the left
            column = np.arange(tokens.shape[1] - 1)
            move = column > best[:, None]
            for grid in (tokens, rank, out):
                grid[:, :-1] = np.where(move, grid[:, 1:], grid[:, :-1])
            n -= 1
            for side in (best - 1, best):
                ok = (side >= 0) & (side < n - 1)
                at = side[ok]
                rank[k[ok], at], out[k[ok], at] = self._find(tokens[k[ok], at], tokens[k[ok], at + 1])
            past = n - 1
            rank[k, past] = none
        return result

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that arrives in chunks, each as soon as it is stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) >= self.lookahead + CHUNK:
                emitted, held = self._emit(held, last=False)
                yield emitted
        if held:
            yield self._emit(held, last=True)[0]

    def _emit(self, held: bytes, last: bool) -> tuple[list[int], bytes]:
        window = held if last else held[: self.lookahead + CHUNK]
        return self._stable(self.merge([window])[0], window, held, last)

    def _stable(self, tokens: list[int], window: bytes, held: bytes, last: bool) -> tuple[list[int], bytes]:
        if last:
            return tokens, b""
        end = taken = 0
        for t in tokens:
            if end + len(self.token_bytes[t]) > len(window) - self.lookahead:
                break
            end, taken = end + len(self.token_bytes[t]), taken + 1
        return tokens[:taken], held[end:]

    def long_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces of any length: windows of all of them advance together, one each."""
        tokens: list[list[int]] = [[] for _ in pieces]
        at, live = [0] * len(pieces), list(range(len(pieces)))
        full = self.lookahead + CHUNK
        while live:
            windows = [pieces[i][at[i] : at[i] + full] for i in live]
            ahead = []
            for i, w, found in zip(live, windows, self.merge(windows), strict=True):
                last = at[i] + len(w) >= len(pieces[i])
                emitted, rest = self._stable(found, w, w, last)
                tokens[i] += emitted
                at[i] += len(w) - len(rest)
                if not last:
                    ahead.append(i)
            live = ahead
        return tokens

    def learn(self, texts: list[list[str]]) -> None:
        """Put what the texts' short pieces need in the cache."""
        met: set[str] = set()
        for pieces in texts:
            met.update(pieces)
        if len(self.cache) > CACHE:  # what these texts need stays, and with it all frequent pieces
            self.cache = {p: self.cache[p] for p in met & self.cache.keys()}
        new = [p for p in met if p not in self.cache and len(p) <= CACHED_CHARS]
        for p, tokens in zip(new, self.long_pieces([p.encode("utf-8", "replace") for p in new]), strict=True):
            self.cache[p] = self._part(tokens)

    def split(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of the text, and whether each is a special token."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts (through the same cached pieces as ``digests``)."""
        return [[int(i) for part, _, _ in parts for i in part.split(",")] for parts in self._parts(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text) of each. Beside the texts there is one block of pieces in memory,
        and two digests and a decoder a text; a piece too long for the cache goes through ``stream``."""
        sinks = [Sink() for _ in texts]
        for block in self._blocks(texts):
            self.learn([pieces for _, special, pieces in block if special is None])
            for i, special, pieces in block:
                if special is not None:
                    sinks[i].feed([(str(self.special[special]), 1, special.encode())])
                    continue
                parts = list(map(self.cache.get, pieces))
                if all(parts):
                    sinks[i].feed(parts)
                    continue
                for piece, part in zip(pieces, parts, strict=True):
                    if part:
                        sinks[i].feed([part])
                        continue
                    for tokens in self.stream(piece[at : at + CHARS].encode("utf-8", "replace") for at in range(0, len(piece), CHARS)):
                        sinks[i].feed([self._part(tokens)])
        return [sink.done() for sink in sinks]

    def _blocks(self, texts: list[str]) -> Iterator[list[tuple[int, str | None, list[str]]]]:
        """Blocks of at most PIECES pieces, over the ends of texts: (text, special token or None, pieces)."""
        block: list[tuple[int, str | None, list[str]]] = []
        room = PIECES
        for i, text in enumerate(texts):
            for s, special in self.split(text):
                if special:
                    block.append((i, s, []))
                    room -= 1
                elif len(s) <= room:  # no more pieces than characters
                    block.append((i, None, self.pieces.findall(s)))
                    room -= len(block[-1][2])
                else:
                    found = (m.group() for m in self.pieces.finditer(s))
                    while pieces := list(islice(found, room)):
                        block.append((i, None, pieces))
                        room -= len(pieces)
                        if room <= 0:
                            yield block
                            block, room = [], PIECES
                if room <= 0:
                    yield block
                    block, room = [], PIECES
        if block:
            yield block

    def _part(self, tokens: list[int]) -> tuple[str, int, bytes]:
        """Ids as text, their number and bytes."""
        return ",".join(map(str, tokens)), len(tokens), b"".join(map(self.token_bytes.__getitem__, tokens))

    def _parts(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """(ids as text, number of ids, their bytes) of each piece of each text."""
        cut = [[(s, special, None if special else self.pieces.findall(s)) for s, special in self.split(text)] for text in texts]
        self.learn([p for stretches in cut for _, special, p in stretches if not special])
        for stretches in cut:
            parts: list[tuple[str, int, bytes]] = []
            for s, special, pieces in stretches:
                if special:
                    parts.append((str(self.special[s]), 1, s.encode()))
                    continue
                get = self.cache.get
                parts += [get(p) or self._long(p) for p in pieces]
            yield parts

    def _long(self, piece: str) -> tuple[str, int, bytes]:
        return self._part(self.long_pieces([piece.encode("utf-8", "replace")])[0])

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream([self.token_bytes[i] for i in ids]))


class Sink:
    """The two digests of one text's tokens as they come, and the decoder between them."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, parts: list[tuple[str, int, bytes]]) -> None:
        """``parts`` of (ids as text, their number, their bytes), none of them empty."""
        if not parts:
            return
        if self.n:
            self.ids.update(b",")
        self.ids.update(",".join([p[0] for p in parts]).encode())
        self.text.update(self.machine.decode(b"".join([p[2] for p in parts])).encode())
        self.n += sum([p[1] for p in parts])

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.machine.decode(b"", final=True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def supported(spec: dict) -> None:
    """Raises ValueError for a tokenizer file whose settings this transducer would not follow."""
    model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
    wrong += ["decoder"] if decoder.get("type") != "ByteLevel" else []
    wrong += [f"added token {t['content']}" for t in spec["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"unsupported settings of the tokenizer file: {', '.join(wrong)}")


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """See the module. taken[t]: the most that rules so far with t on the left need;
    formed[t]: what t's right part needs up to the rule that forms t."""
    taken: dict[int, int] = {}
    formed: dict[int, int] = {}
    need = lambda t: max(taken.get(t, 0), formed.get(t, 0))
    for a, b, c in rules:
        beyond = size[b] + need(b)
        formed[c] = max(formed.get(c, 0), need(b))
        taken[a] = max(taken.get(a, 0), beyond)
    return max([1, *taken.values(), *formed.values()])


def decode_stream(chunks: list[bytes], block: int = 4096) -> Iterator[str]:
    """Text of the tokens' bytes, ``block`` tokens at a time; at most three bytes are carried."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(chunks), block):
        yield machine.decode(b"".join(chunks[at : at + block]))
    yield machine.decode(b"", final=True)


_machines: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each file and Python worker."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


#: Texts whose unknown pieces are merged together.
TEXTS = 256


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded: the tokens of whole texts, and the text they give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path or default_file())
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                ids = machine.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([machine.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; neither ids nor all pieces of a text are kept, so
    beside the text memory doesn't depend on its length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path or default_file())
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                n, ids, decoded = zip(*machine.digests([t or "" for t in part.column("text").to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        machine.cache.clear()  # workers live on; what they keep counts against the executor's next stage

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_transducer(spark, sf_dir):
    from touchline.llm.common import table

    return token_digests(table(spark, sf_dir, "documents"))
