"""Operator 10: BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word the last token of its encoding is unique.  Candidates for it are the
vocabulary entries that end there (all matches of a suffix automaton over the vocabulary); a candidate
is the one if it may follow the last token of the prefix before it, which a test on the pair decides.
Back-pointers from the end of the word give the ids.

Nulls and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import Remembered, in_worker, table

END = "</w>"
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct chunks that one Python worker remembers in each of two generations, and pairs of tokens.
REMEMBERED, PAIRS = 200_000, 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder for a tokenizer file with word ends (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = vocab
        self.text = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        # what each token is made of, and when: the merge's place in the order
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        for order, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((left, right), (order, whole))
            self.parts.setdefault(whole, (order, left, right))
        # an end of word is one letter of the automaton, so that it never stands apart from the last byte
        self.ends = ahocorasick.Automaton()
        for word, i in vocab.items():
            closed = int(word.endswith(END) and len(word) > len(END))
            body = word[: -len(END)] if closed else word
            self.ends.add_word(body + "\n" * closed, (i, len(body), closed))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.latin = regex.compile("[\x00-\u024f]*")
        self.library = Tokenizer.from_file(path)  # for its normalizer and its splitter only
        self.spaces = regex.compile(rf"[{SPACES}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b in order of rank leaves the border between them alone.

        Walk back in time along the right edge of a and the left edge of b.  The merge of what stands at the
        border would come first if its rank is below that of the merge that takes away its left part, or not
        above that of the merge that takes away its right part (of equal merges the left one goes first).
        """
        x, y, until_x, until_y, fine = a, b, None, None, True
        while True:
            over = self.joined.get((x, y))
            if over and (until_x is None or over[0] < until_x) and (until_y is None or over[0] <= until_y):
                fine = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or px is not None and px[0] > py[0]:
                until_x, x = px[0], px[2]
            else:
                until_y, y = py[0], py[1]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = fine
        return fine

    def stands(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token; a few entries can never be reached."""
        known = self.whole.get(token)
        if known is None:
            made = self.parts.get(token)
            known = made is None or self.merged(self.text[token]) == [token]
            self.whole[token] = known
        return known

    def merged(self, word: str) -> list[int]:
        """Merging by rank, for the test above."""
        closed = word.endswith(END) and len(word) > len(END)
        letters = list(word[: -len(END)] if closed else word)
        if closed:
            letters[-1] += END
        ids = [self.ids[c] for c in letters]
        while True:
            found = [(self.joined[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.joined]
            if not found:
                return ids
            _, i = min(found)
            ids[i : i + 2] = [self.joined[ids[i], ids[i + 1]][1]]

    def letters_of_word(self, body: str) -> list[int]:
        """body: a letter for each byte of the word."""
        n = len(body)
        last, back, pairs = [-1] * (n + 1), [0] * (n + 1), self.pairs
        for end, (token, size, closed) in self.ends.iter(body + "\n"):
            # the mark of the end of the word is letter n; a token without it can't end at the last byte
            at = end + 1 - closed
            if last[at] >= 0 or at == n and not closed:
                continue
            start = at - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fine = pairs.get(before << 20 | token)
                if fine is None:
                    fine = self.may_follow(before, token)
                if not fine:
                    continue
            if self.stands(token):
                last[at], back[at] = token, start
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no encoding of {body!r}")
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def plain(self, text: str) -> list[int]:
        if text.isascii():
            pieces = self.split.findall(text.lower())
        elif self.latin.fullmatch(text):
            pieces = self.split.findall("".join([c.lower() for c in self.spaces.sub(" ", unicodedata.normalize("NFC", text))]))
        else:  # rare letters: their classes as the library's edition of Unicode has them
            library = self.library
            return [i for body, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text)) for i in self.letters_of_word(body)]
        letters = self.letters
        return [i for piece in pieces for i in self.letters_of_word(piece if piece.isascii() and piece.isalnum() else "".join([letters[b] for b in piece.encode()]))]

    def encode(self, text: str) -> list[int]:
        """Any text; white space between chunks separates words, so chunks can be encoded one by one."""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        ids: list[int] = []
        for part in self.specials.split(text):
            ids += [self.special[part]] if part in self.special else self.plain(part) if part else []
        return ids

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens, with a blank between."""
        return " ".join([self.text[i] for i in ids])


class Chunks:
    """Encodes whole texts chunk by chunk between ASCII white space and remembers chunks."""

    def __init__(self, path: str):
        self.bpe, self.known = PrefixBpe(path), Remembered(REMEMBERED)

    @staticmethod
    def of(path: str) -> Chunks:
        """One for all tasks of a Python worker."""
        return in_worker(Chunks, path)

    def __call__(self, text: bytes) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        chunks = text.split()
        missing = self.known.missing(set(chunks))
        known = self.known.now
        for c in missing:
            ids = self.bpe.encode(c.decode())
            known[c] = (b"".join([i.to_bytes(4, "little") for i in ids]), "".join([self.bpe.text[i] + " " for i in ids]).encode())
        pairs = [known[c] for c in chunks]
        return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])[:-1]

    def of_column(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        for at in range(0, len(column), 500):
            yield from (self(t or b"") for t in column.slice(at, 500).cast(pa.binary()).to_pylist())


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded text.  tokenizer: path of the file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks.of(tokenizer)
        for b in batches:
            out = list(chunks.of_column(b.column("text")))
            columns = [b.column("doc_id"), pa.array([len(i) // 4 for i, _ in out], pa.int64()), pa.array([i for i, _ in out], pa.binary()), pa.array([d.decode() for _, d in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As bpe_round_trip, with digests in place of ids and text, so that only those leave the Python worker."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks.of(tokenizer)
        for b in batches:
            out = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in chunks.of_column(b.column("text"))]
            columns = [pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[k] for o in out], pa.string()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
