"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proven once, on the driver,
by running the vocabulary's own merges over each of them (a vocabulary has a fixed
size; the proven set is broadcast). In the tasks a pre-token in that set counts as
one token without any merging; only the others are merged, each distinct one once
per task as long as a bounded memo holds it.

Defined results: null text is the empty text, 0 tokens; special strings inside a
text count as the library counts them, one token each; texts of any length are
counted whole; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import query, table, texts, tokenizer_file

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
MEMO_ENTRIES = 500_000

# Up to here the library's normal form only lower-cases, character by character;
# other characters, and the ASCII separators, take the library's own normalizer.
_PLAIN = r"[\x00-\x1B\x20-\x84\x86-ɏ]*+"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


def proven_whole(path: str) -> frozenset[str]:
    """The byte-level strings of the vocabulary that encode alone as a single token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = json.load(open(path, encoding="utf-8"))["model"].get("end_of_word_suffix") or ""
    found = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(suffix):
            word = entry[: len(entry) - len(suffix)]
            if word and len(tokenizer.model.tokenize(word)) == 1:
                found.add(word)
    return frozenset(found)


def token_counter(path: str, whole: frozenset[str]) -> Callable[[str], int]:
    """``count(text)`` for the vocabulary at ``path``; ``whole`` as ``proven_whole`` gives it."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec["added_tokens"] if t["special"]]
    split = regex.compile("|".join(map(regex.escape, special))) if special else None
    words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    plain = regex.compile(_PLAIN)
    letters = _byte_letters()
    merges = tokenizer.model.tokenize
    memo: dict[str, int] = {}
    mapped: dict[str, int] = {}  # the same, by byte-level string

    def merged(word: str) -> int:
        n = mapped.get(word)
        if n is None:
            if len(mapped) >= MEMO_ENTRIES:
                mapped.clear()
            n = mapped[word] = 1 if word in whole else len(merges(word))
        return n

    def count_word(word: str) -> int:
        n = memo.get(word)
        if n is None:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            n = memo[word] = merged("".join([letters[b] for b in word.encode()]))
        return n

    def count_part(text: str) -> int:
        if plain.fullmatch(text):
            return sum(map(count_word, words.findall(text.lower())))
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
        return sum(merged(piece) for piece, _ in pieces)

    def count(text: str) -> int:
        if split is None or "<" not in text:
            return count_part(text)
        parts = split.split(text)
        return len(parts) - 1 + sum(map(count_part, parts))

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: n_bytes, n_tokens and whether it is over ``limit``."""
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole(tokenizer_file(vocabulary)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer_file(vocabulary), whole.value)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(counts, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
