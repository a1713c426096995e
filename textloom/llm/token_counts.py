"""Token counts through a digest cache.

Every text has a content digest, every tokenizer a digest of its file. Counts are stored in a table under the pair of both:
a job joins its digests to the stored counts, encodes each distinct missing text once, appends the new counts, and joins the
completed table back to the documents. Copies of a text, in this job or a later one, are never encoded again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import chunks

CACHE_SCHEMA = "tokenizer STRING, digest STRING, n_tokens LONG"
#: Entries of the word memo of one task; it is emptied when full, so its memory is bounded.
MEMO_WORDS = 400_000


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Count function of a SentencePiece model.

    When no piece of the vocabulary goes on past a blank that follows other characters, merges never cross such a place, and the
    count of a text is the sum of the counts of its words. Then words are counted once for each task. A model with other pieces, or
    one that rewrites text (normalizer other than identity), is always applied to whole texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = "▁"
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    by_word = not any(re.search(f"[^{blank}]{blank}", p) for p in pieces) and keeps_text(model)
    memo: dict[str, int] = {}

    def whole(texts: list[str]) -> list[int]:
        return [len(ids) for ids in model.encode(texts, num_threads=1)]

    def learn(segments: list[str]) -> None:
        """A segment is blanks followed by a word (one leading blank is the dummy prefix), or blanks at the end."""
        words = [s for s in segments if s[-1] != blank]
        memo.update(zip(words, whole([s[1:] for s in words])))
        tails = [s for s in segments if s[-1] == blank]
        memo.update(zip(tails, (n - alone for n in whole(["a" + s for s in tails]))))

    alone = whole(["a"])[0]
    segment = re.compile(f"{blank}*[^{blank}]+|{blank}+")

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            found = segment.findall(blank + text.replace(" ", blank))
            new = [s for s in set(found) if s not in memo]
            if new:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                    new = list(set(found))
                learn(new)
            out.append(sum(map(memo.__getitem__, found)))
        return out

    return count if by_word else whole


def keeps_text(model) -> bool:
    """Whether the model's normalizer leaves text as it is (probed on characters that the usual normal forms change)."""
    probe = ["a  b", " a ", "Äﬁ①Ａ　 ​́\t\n\r­Ω"]
    return all(model.normalize(p) == "▁" + p.replace(" ", "▁") for p in probe)


def json_counter(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer. Two jobs may have added the same digest: it then stands once here."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, model_path: str, limit: int = 4096, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Tokens of every whole text.

    ``cache`` is a folder that all executors share; it is made on first use and only ever appended to. ``model_path`` names a ``.model`` or
    ``.json`` file that every executor has; its digest, not its name, marks the stored counts. Returns ``key``, n_bytes (UTF-8), n_tokens,
    over_limit (more than ``limit`` tokens) and content_digest.

    Null counts as the empty text: 0 bytes, 0 tokens. Repeated rows and null keys come back as often as they came in. Extra columns are
    not read. An empty table gives an empty result. Nothing but null is rewritten before the digest is taken, because the count of
    a text belongs to its exact characters.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(model_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"),
                        F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("body"))
    # Copies meet in the map task already, so a text with a third of all rows is sent once for each task.
    distinct = keyed.groupBy("digest").agg(F.first("body").alias("body"))
    missing = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    make = piece_counter if model_path.endswith(".model") else json_counter

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make(model_path)
        for batch in batches:
            texts = batch["body"].tolist()
            found = [n for part in chunks(texts) for n in count(texts[part])]
            yield pd.DataFrame({"tokenizer": tokenizer, "digest": batch["digest"], "n_tokens": pd.Series(found, dtype="int64")})

    missing.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return (keyed.drop("body").join(read_cache(spark, cache, tokenizer), "digest", "left")
            .select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                    F.col("digest").alias("content_digest")))
