"""Byte-level BPE token counts at every prefix, and token ids, both remembered by chunk.

A chunk begins at a single space or at a line end, and takes it along. The vocabulary's pattern always starts a new piece
at a single space that a visible character follows, and takes one or two line ends between visible characters as pieces
of their own, so chunks are encoded one by one and a text's tokens are the tokens of its chunks in order. Texts with
other white space at a chunk's ends are taken as one chunk.

Whether a character counts as a letter, a number or white space depends on a library's version of Unicode; the classes
are therefore asked from the tokenizer's own splitter, once for each character that is not ASCII.

Prefix dynamic programming: within a piece, the encoding of the first i bytes ends in exactly one token, the one that
is compatible with the last token of the prefix before it; so count[i] = count[i - len(last token)] + 1. The table
holds the count of every prefix, and answers how many tokens a cut text has, or where to cut it for a budget,
without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import per_worker, read, sliced

#: The vocabulary's own pattern (a fixed value of the public byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by a worker, and their most characters; others are worked out each time, so memory stays bounded.
REMEMBERED, REMEMBERED_CHARS = 300_000, 60
#: Chunks whose token counts are remembered, which take less room than ids and more time to work out again.
REMEMBERED_COUNTS = 1_000_000
#: The last character whose class all versions of Unicode in use agree on beyond doubt (end of Latin Extended-B).
STABLE = "\u024f"
#: Pieces of more bytes are searched for tokens by an automaton instead of a look-up for every length.
LONG_PIECE = 64


def chunks_of(text: str) -> list[str] | None:
    """The chunks of a text without special strings, those after a space without it; None if runs of line ends need the whole text.

    Chunks that are empty, or have white space at an end after their line end, need the whole text as well (see plain).
    """
    if "\n" in text:
        if "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"):
            return None
        text = text.replace("\n", " \n")
    return text.split(" ")


def whole(chunk: str) -> str:
    """A chunk with the white space that it begins with."""
    return chunk if chunk[:1] == "\n" else " " + chunk


def plain(chunk: str) -> bool:
    """Whether a chunk can be encoded apart from its neighbours."""
    if chunk == "\n":
        return True
    inner = chunk[1:] if chunk[:1] == "\n" else chunk
    return bool(inner) and not inner[0].isspace() and not inner[-1].isspace()


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixCounter:
    """Token counts of whole texts and of all their prefixes, for the vocabulary in a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        added = set(self.specials)
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}  # by merge; bytes come before all merges
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.halves[whole] = pair_ids = (vocab[left], vocab[right])
            self.merged[pair_ids] = rank
            self.order[whole] = rank
        self.pattern = regex.compile(PATTERN)
        self.white = regex.compile(r"\s+")
        self.splitter = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        from tokenizers.pre_tokenizers import ByteLevel

        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.asked: set[str] = set()
        self.stand_in: dict[int, str] = {}  # for characters that the pattern takes for another class than the splitter
        self.automaton = None

    def shadow(self, text: str) -> str:
        """The text with stand-ins for characters of another Unicode version, one for one."""
        if text.isascii():
            return text
        for c in set(text) - self.asked:
            self.asked.add(c)
            if not c.isascii():
                mine = "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else " " if regex.match(r"\s", c) else "!"
                theirs = next((x for x in "a1!" if len(self.split(x + c)) == 1), " ")
                if mine != theirs:
                    self.stand_in[ord(c)] = "\x85" if theirs == " " else theirs
        return text.translate(self.stand_in) if self.stand_in else text

    def pieces(self, text: str) -> list[str]:
        shadow = self.shadow(text)
        return self.pattern.findall(text) if shadow is text else [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b yields just these two: no merge across their border comes before the merges that built them."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = self._undo(a, b)
            if len(self.fits) < REMEMBERED:
                self.fits[key] = known
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Takes the later of the two last merges apart again and again; a border merge that is due before it decides."""
        order, halves = self.order, self.halves
        bound = 1 << 60  # merges from here on have been taken apart
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            made_left, made_right = order.get(left, -1), order.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                # Equal merges run from left to right: the border pair of the same rank comes after the left one.
                bound, left = made_left, halves[left][1]
            else:
                bound, right = made_right + 1, halves[right][0]

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of one piece."""
        n, ids, longest, fits, slow = len(piece), self.ids, self.longest, self.fits, self.compatible
        last, count = [0] * (n + 1), [0] * (n + 1)
        if n > LONG_PIECE:
            if self.automaton is None:
                self.automaton = ahocorasick.Automaton()
                for raw, token in ids.items():
                    self.automaton.add_word(raw.decode("latin-1"), (len(raw), token))
                self.automaton.make_automaton()
            for at, (size, token) in self.automaton.iter(piece.decode("latin-1")):  # longest first at each end
                start, end = at + 1 - size, at + 1
                if not count[end] and (not start or slow(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
            return count[1:]
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(piece[start:end])
                if token is not None:
                    if start:
                        ok = fits.get((last[start], token))
                        if ok is None:
                            ok = slow(last[start], token)
                        if not ok:
                            continue
                    last[end], count[end] = token, count[start] + 1
                    break
        return count[1:]

    def prefix_counts(self, chunk: str) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of a text without special strings, each as if the text ended there."""
        out: list[int] = []
        before, space = 0, b""
        for piece in self.pieces(chunk):
            raw = piece.encode()
            counts = self.piece_counts(raw)
            if len(raw) == 3 and raw[:1] == b"'" and raw[1:].isalpha():
                counts[1] = counts[0] + self.piece_counts(raw[1:2])[0]  # a contraction cut short is a quote and a letter
            at = [before + c for c in counts]
            white = self.white.fullmatch(self.shadow(piece))
            if space and (white or raw[:1] == b" "):
                # Cut after this white space, it belongs to the run before it.
                run = raw if white else b" "
                at[len(run) - 1] = before - self.piece_counts(space)[-1] + self.piece_counts(space + run)[-1]
            out += at
            before += counts[-1]
            space = raw if white else b""
        return out

    def _new(self, chunk: str) -> int:
        n = 0
        for piece in self.pieces(chunk):
            n += self.piece_counts(piece.encode())[-1]
        return n

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Special strings (true) and the text before, between and after them."""
        if self.splitter is None or not any(s in text for s in self.specials):
            return [(text, False)]
        out: list[tuple[str, bool]] = []
        at = 0
        for m in self.splitter.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def chunk_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Chunks, all but the first as in chunks_of, and their token counts; one chunk where the text needs it."""
        chunks = chunks_of(text)
        if chunks is None:
            return [text], [self._new(text)]
        known = self.known
        counts = list(map(known.get, chunks))
        first = chunks[0]
        if first and (first[0].isspace() or first[-1].isspace()):
            return [text], [self._new(text)]
        counts[0] = self._new(first)
        if None in counts:
            for k, n in enumerate(counts):
                if n is None:
                    chunk = chunks[k]
                    n = known.get(chunk)
                    if n is None:
                        if not plain(chunk):
                            return [text], [self._new(text)]
                        n = self._new(whole(chunk))
                        if len(known) < REMEMBERED_COUNTS and len(chunk) < REMEMBERED_CHARS:
                            known[chunk] = n
                    counts[k] = n
        return chunks, counts

    def count(self, text: str) -> int:
        return sum(1 if special else sum(self.chunk_counts(part)[1]) for part, special in self.parts(text) if part)

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The token count, and the bytes of the longest prefix of whole characters with at most budget tokens."""
        total = cut = at = 0
        for part, special in self.parts(text):
            if not part:
                continue
            long = len(part) if part.isascii() else len(part.encode())
            chunks, counts = ([part], [1]) if special else self.chunk_counts(part)
            size = sum(counts)
            if total + size <= budget:
                cut = at + long
            elif total <= budget and not special:
                left = budget - total
                k = next(i for i, s in enumerate(accumulate(counts)) if s > left)
                end = k + 1
                while k > 1 and chunks[k - 1] == "\n":  # a text that ends inside a run of white space has it in one piece
                    k -= 1
                names = [chunks[0], *map(whole, chunks[1:end])]
                begin = len("".join(names[:k]).encode())
                chunk = "".join(names[k:])
                left -= sum(counts[:k])
                raw = chunk.encode()
                inside = [i for i, c in enumerate(self.prefix_counts(chunk), 1) if c <= left and (i == len(raw) or raw[i] & 0xC0 != 0x80)]
                cut = at + begin + (inside[-1] if inside else 0)
            at += long
            total += size
        return total, cut


@per_worker
def counter(path: str) -> PrefixCounter:
    """One per worker process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_bytes (the longest prefix that has at most limit tokens) per row.

    Null and empty texts have no bytes and no tokens. Repeated rows and doc_ids, null ids included, come out once each;
    other columns are not read. Empty tables give no rows. Rows are independent, so a lost task is simply run again.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(path)
        for batch in sliced(batches, "text", keep=True):
            size, total, cut = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n = len(text.encode())
                tokens, at = held.measure(text, limit)
                size.append(n)
                total.append(tokens)
                cut.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([t > limit for t in total], pa.bool_()), pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


class ChunkEncoder:
    """Ids as the tokenizers library gives them, little-endian 32-bit, remembered by chunk.

    Chunks that are not remembered are encoded side by side, with a line end between them, by tiktoken from the same file's
    merges, which takes a quarter of the time; whatever could depend on a version of Unicode or on runs of white space
    goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = self._encode("\n")
        self.fast = self._ranked(path)
        self.known: dict[str, bytes] = {"\n": self.end}
        self.heads: dict[str, bytes] = {"": b""}

    def _ranked(self, path: str):
        """The vocabulary by ranks, if its ids follow the order of its merges and a line end between words is one token; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        if len(self.end) != 4 or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(symbols[c] for c in s): i for s, i in vocab.items() if i < 256 + len(pairs)}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = " a\n b's 12\nc, \u00e9t\u00e9\n -- \"x\""
        return fast if pack("<%dI" % len(fast(probe)), *fast(probe)) == self._encode(probe) else None

    def _encode(self, text: str) -> bytes:
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return pack(f"<{len(ids)}I", *ids)

    def _learn(self, table: dict[str, bytes], wanted: set[str], before: str, most: int) -> dict[str, bytes]:
        """Ids of wanted chunks that the table does not have, each with what stands before it; some are remembered."""
        new: dict[str, bytes] = {}
        order = list(wanted)
        for at in range(0, len(order), 20_000):
            some = order[at : at + 20_000]
            if self.fast:
                for c in some:
                    if max(c) > STABLE:
                        new[c] = self._encode(before + c)
                some = [c for c in some if c not in new]
                raw = np.array(self.fast("\n".join([before + c for c in some])), "<u4")
                cuts = 4 * np.flatnonzero(raw == int.from_bytes(self.end, "little"))
                raw = raw.tobytes()
                new.update((c, raw[a:b]) for c, a, b in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)) if some else None
            else:
                new.update((c, self._encode(before + c)) for c in some)
        if (room := most - len(table)) > 0:
            table.update(islice(((c, raw) for c, raw in new.items() if len(c) < REMEMBERED_CHARS), room))
        return new

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of whole texts, one after another; chunks that are not remembered are encoded together first."""
        known, heads = self.known, self.heads
        found: list[list | None] = []
        open_: list[tuple[int, list[str], list[int]]] = []
        fresh: set[str] = set()
        starts: set[str] = set()
        for k, text in enumerate(texts):
            chunks = None if any(s in text for s in self.specials) else chunks_of(text)
            if chunks is None or (chunks[0] and (chunks[0][0].isspace() or chunks[0][-1].isspace())):
                found.append(None)
                continue
            got = list(map(known.get, chunks))
            got[0] = heads.get(chunks[0])
            if None in got:
                missing = [i for i, raw in enumerate(got) if raw is None]
                open_.append((k, chunks, missing))
                if missing[0] == 0:
                    starts.add(chunks[0])
                    del missing[0]
                fresh.update(map(chunks.__getitem__, missing))
            found.append(got)
        odd = {c for c in fresh if not plain(c)}
        lines = {c for c in fresh - odd if c[0] == "\n"}
        starts.update(c[1:] for c in lines if c[1:] not in heads)
        first = self._learn(heads, starts, "", REMEMBERED // 4)
        new = self._learn(known, fresh - odd - lines, " ", REMEMBERED)
        for c in lines:
            raw = first.get(c[1:])
            new[c] = self.end + (heads[c[1:]] if raw is None else raw)
        if (room := REMEMBERED - len(known)) > 0:
            known.update(islice(((c, new[c]) for c in lines if len(c) < REMEMBERED_CHARS), room))
        for k, chunks, missing in open_:
            got = found[k]
            if odd and not odd.isdisjoint(map(chunks.__getitem__, missing)):
                found[k] = None
                continue
            if got[0] is None:
                got[0] = first[chunks[0]]
            for i in missing:
                got[i] = new[chunks[i]]
        del new, open_
        for k, got in enumerate(found):
            yield self._encode(texts[k]) if got is None else b"".join(got)
            found[k] = None


@per_worker
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
