"""BPE encoding and decoding with forced-boundary splitting.

A vocabulary fixes which byte pairs occur inside some token. Where two neighbouring bytes of a word form
a pair that no token contains, no merge can ever cross: there the word is cut, its fragments are encoded
independently (and remembered), and their ids are concatenated. The result equals that of merging the whole word.

Texts are handled as the vocabulary's file says: its added tokens are found in the raw text first; the
rest is composed (NFC), runs of white space become one space, letters are lower-cased one by one, words are cut out by
the file's pattern, and each word's UTF-8 bytes are merged with an end-of-word mark on the last.
Decoding joins the tokens' own strings by one space, which is what a file without a decoder asks for.

Null and empty texts give no tokens and an empty decoded text. Rows keep their order and number, repeated
ones too; an empty table gives an empty result; other columns are ignored. Texts of any length are encoded
whole; memory beside the text itself is bounded by the size of the two caches.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a generation of each cache in a worker: ids of what stands between white space, and of fragments.
CHUNKS, FRAGMENTS = 180_000, 90_000
#: Bytes of text after which a batch of results is handed back.
FLUSH = 4 << 20
END = "</w>"
#: White_Space of Unicode, as the file's \s means it.
WHITE = "\t-\r \x85\xa0  -     　"


# Where the library's tables of Unicode are older or newer than those of the regex package and of Python, as first and last code points.
#: Letters and numbers of the regex package that the library takes for neither.
NO_LETTERS = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
NO_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Marks of Python's NFC that the library's neither moves nor composes.
NO_MARKS = "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
#: Capitals that only the library lowers, first to last, with what the first becomes; the others follow in order.
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
# End of the fixed values.
LOWERED = {c: first + c - a for a, b, first in CAPITALS for c in range(a, b + 1)}


def members(intervals: str) -> str:
    """Intervals of code points as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in i.split("-")) for i in intervals.split())


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(moved.get(b, b)) for b in range(256)]


class _Recent(dict):
    """Ids of texts, worked out by `make` when first asked for. Of the last `limit` entries and as many before, those asked for again stay."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.pop(text, None)
        if ids is None:
            ids = self.make(text)
        if len(text) < 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Encodes texts with one vocabulary file, given as its JSON text."""

    def __init__(self, vocabulary: str):
        import regex

        parsed = json.loads(vocabulary)
        self.ids: dict[str, int] = parsed["model"]["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(parsed["model"]["merges"])}
        self.added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.added).items()}
        self.letters = byte_letters()
        (pattern,) = (x["pattern"]["Regex"] for x in parsed["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = pattern.replace(r"\s", WHITE)
        self.words = regex.compile(pattern)
        # the same with the library's letters and numbers, for the few texts in which they differ
        for name, without in (("L", NO_LETTERS), ("N", NO_NUMBERS)):
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{members(without)}]]")
        self.library_words = regex.compile(pattern, regex.V1)
        self.newer = regex.compile(f"[{members(NO_LETTERS)}{members(NO_NUMBERS)}{''.join(map(chr, LOWERED))}]")
        self.marks = regex.compile(f"([{members(NO_MARKS)}])")
        self.white = regex.compile(f"[{WHITE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.inside: set[str] = set()  # pairs of letters inside some token; with END where the second ends a word
        for token in self.ids:
            last, body = token.endswith(END) and len(token) > len(END), token.removesuffix(END) if len(token) > len(END) else token
            self.inside.update(body[i : i + 2] for i in range(len(body) - 1 - last))
            if last and len(body) > 1:
                self.inside.add(body[-2:] + END)
        self.fragments, self.chunks = _Recent(self.merge, FRAGMENTS), _Recent(self.chunk, CHUNKS)

    def cut(self, word: str) -> list[str]:
        """Fragments of a word in byte letters; the last one carries END."""
        inside, start, out = self.inside, 0, []
        if len(word) == 1 or word[-2:] + END in inside and inside.issuperset(map(add, word[:-2], word[1:-1])):
            return [word + END]
        for i in range(1, len(word)):
            pair = word[i - 1 : i + 1]
            if (pair if i < len(word) - 1 else pair + END) not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:] + END)
        return out

    def merge(self, fragment: str) -> tuple[int, ...]:
        """Ids of a fragment: the pair of lowest rank merges first, the leftmost of equals."""
        end = fragment.endswith(END) and len(fragment) > len(END)
        parts: list[str | None] = list(fragment[: -len(END)] if end else fragment)
        if end:
            parts[-1] += END
        if len(parts) == 1:
            return (self.ids[parts[0]],)
        if len(parts) < 24:
            return self._merge_short(parts)
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            if (k := before[i]) >= 0 and (p := (parts[k], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], k, *p))
        return tuple(self.ids[p] for p in parts if p is not None)

    def _merge_short(self, parts: list[str]) -> tuple[int, ...]:
        get, none = self.ranks.get, len(self.ranks)
        found = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found and (low := min(found)) < none:
            i = found.index(low)
            parts[i] += parts.pop(i + 1)
            found.pop(i)
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), none)
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), none)
        return tuple(map(self.ids.__getitem__, parts))

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of normalised text without white space."""
        letters, out, known = self.letters, [], self.fragments
        words = self.words
        if not text.isascii() and self.newer.search(text):
            words, text = self.library_words, text.translate(LOWERED)
        for word in words.findall(text):
            plain = word.isascii() and word.isprintable()  # such bytes stand for themselves
            for fragment in self.cut(word if plain else "".join([letters[b] for b in word.encode()])):
                out.extend(known[fragment])
        return tuple(out)

    def split(self, text: str) -> list[str]:
        """Normalised text, cut at white space."""
        if not unicodedata.is_normalized("NFC", text):
            text = "".join(unicodedata.normalize("NFC", x) for x in self.marks.split(text))
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        # str.split also cuts at four control characters that are no white space in Unicode
        return self.white.split(text) if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) else text.split()

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """Tuples of ids whose concatenation encodes a text."""
        if self.specials is not None and self.specials.search(text):
            parts = self.specials.split(text)
            return list(chain.from_iterable([(self.added[p],)] if p in self.added else self.pieces(p) for p in parts))
        return list(map(self.chunks.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary in a worker, so that its caches serve all tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id unless given) plus n_tokens long, ids array<int>, decoded string: one row per row of docs.

    path is the vocabulary's file on the driver. Its text (1.7 MB here; a vocabulary is a file of fixed size)
    is broadcast. A text goes through in one map task: no shuffle.
    """
    with open(path or public_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    out = rows.drop("text").schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts, start, held, lists, decoded = batch.column("text"), 0, 0, [], []
            for i in range(batch.num_rows):
                ids = enc.encode(text := texts[i].as_py())
                lists.append(ids)
                decoded.append(enc.decode(ids))
                held += len(text)
                if held >= FLUSH or i == batch.num_rows - 1:
                    counts = list(map(len, lists))
                    offsets = [0]
                    for c in counts:
                        offsets.append(offsets[-1] + c)
                    ids_column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(chain.from_iterable(lists)), pa.int32()))
                    kept = batch.column("kept").slice(start, len(lists))
                    yield pa.RecordBatch.from_arrays([kept, pa.array(counts, pa.int64()), ids_column, pa.array(decoded, pa.string())], names=["kept", "n_tokens", "ids", "decoded"])
                    start, held, lists, decoded = i + 1, 0, [], []

    return rows.mapInArrow(run, out).select("kept.*", "n_tokens", "ids", "decoded")


def op4_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return bpe(docs).select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
