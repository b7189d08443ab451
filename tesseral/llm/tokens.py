"""Encoding a corpus with a public byte-level tokenizer through a table of distinct words (problem 7)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators.skew import salted_join
from tesseral.session import cut_lineage, scratch

#: Folder of the vocabulary files; the same on every machine.
TOKENIZERS = os.environ.get("TESSERAL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a chunk at most, unless one document has more. A chunk is put together in one piece of memory.
CHUNK_WORDS = 1 << 19


def _ranks(folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(folder: str):
    import tiktoken

    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=_ranks(folder), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


CHUNK = "chunk long, pos int, doc_id long, codes array<int>, code int, word string, n int"


def _words_of(words: pa.Array, raw: pa.Array) -> pa.Array:
    """The lists of words, those of raw texts cut here."""
    if raw.null_count == len(raw):
        return words
    cut = [w if t is None else _splitter().findall(t) for w, t in zip(words.to_pylist(), raw.to_pylist())]
    return pa.array(cut, pa.list_(pa.string()))


def _chunked(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[pa.RecordBatch]:
    """Each document's words as places in a table of the distinct words of its chunk, and the tables."""
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        words = _words_of(batch.column("words"), batch.column("raw"))
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = words.flatten(), np.cumsum(size)
        first = 0
        while first < len(size):
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + chunk_words, "right")))
            coded = flat.slice(start, int(ends[last - 1]) - start).dictionary_encode()
            codes, table = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            chunk, k = (task << 32) + k, k + 1
            offsets = np.concatenate([[0], ends[first:last] - start]).astype(np.int32)
            yield _rows(chunk, last - first, pos=pa.array(np.arange(first, last, dtype=np.int32)), doc_id=batch.column("doc_id").slice(first, last - first), codes=pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())))
            count = np.bincount(codes, minlength=len(table)).astype(np.int32)
            yield _rows(chunk, len(table), code=pa.array(np.arange(len(table), dtype=np.int32)), word=table, n=pa.array(count))
            first = last


def _rows(chunk: int, many: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "pos": pa.int32(), "doc_id": pa.int64(), "codes": pa.list_(pa.int32()), "code": pa.int32(), "word": pa.string(), "n": pa.int32()}
    columns["chunk"] = pa.array(np.full(many, chunk, dtype=np.int64))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(many, t)).cast(t) for c, t in kinds.items()], names=list(kinds))


def split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The corpus cut into words, read and cut once and written to the shared folder; see CHUNK for the columns.

    A row is a document (chunk, pos, doc_id, codes: its words by their places in the chunk's table) or a word of a chunk's
    table (chunk, code, word, n). A chunk is at most ``chunk_words`` words, or one document. The JVM's regular expressions cut
    the texts by the tokenizer's pattern, no character is lost; texts with characters that its Unicode tables don't know
    yet (unassigned there, perhaps letters by now) are cut by a newer table in Python.
    """
    unknown = F.col("text").rlike(r"\p{Cn}")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.when(~unknown, F.regexp_extract_all("text", F.lit(f"(?U){PATTERN}"), F.lit(0))).alias("words"), F.when(unknown, F.col("text")).alias("raw")
    )
    folder = scratch(docs.sparkSession, "words")
    texts.mapInArrow(lambda batches: _chunked(batches, chunk_words), CHUNK).write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(CHUNK).parquet(folder)


def word_table(words: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(word, n, rows, ids): every distinct word of ``words`` (word, n), how often it occurs, in how many rows, and its ids.

    Counted before the shuffle; each distinct word is encoded once, in Arrow batches.
    """
    counted = words.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder)
        for pdf in batches:
            yield pdf.assign(ids=[enc.encode_ordinary(w) for w in pdf["word"]])

    return counted.mapInPandas(encode, "word string, n long, rows long, ids array<int>")


def _joined(docs: DataFrame, doc_id: str, text: str, folder: str, value: str, kind: str, schema: str, finish, chunk_words: int) -> DataFrame:
    """Every chunk's documents beside its table with ids (or another ``value`` of them), put together by ``finish``."""
    chunks = split(docs, doc_id, text, chunk_words)
    lines, words = chunks.where("word is null"), chunks.where("word is not null").select("chunk", "code", "word", "n")
    known = cut_lineage(word_table(words.select("word", "n"), folder))
    by_word = known.select("word", F.expr(value).alias("value"))
    table = salted_join(words.select("chunk", "code", "word"), by_word, ["word"], spread=["chunk"], counts=known.select("word", F.col("rows").alias("_n")))
    # repeated rows of a document: all but the first are named to the chunk that holds them
    at = lines.select("doc_id", "chunk", "pos")
    more = at.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("chunk", "pos")).alias("_first")).where("_n > 1")
    again = at.join(more, F.col("doc_id").eqNullSafe(F.col("_id"))).where(F.struct("chunk", "pos") != F.col("_first"))
    side = table.select("chunk", "code", "value", F.lit(None).cast("int").alias("gone")).unionByName(
        again.select("chunk", F.lit(None).cast("int").alias("code"), F.lit(None).cast(kind).alias("value"), F.col("pos").alias("gone"))
    )
    return lines.select("chunk", "pos", "doc_id", "codes").groupBy("chunk").cogroup(side.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(finish, schema)


def _placed(lines: pa.Table, side: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(doc_ids, words per document, codes, values by code) of a chunk, without the documents that are gone."""
    gone = side.column("gone").drop_null()
    if len(gone):
        lines = lines.filter(pc.invert(pc.is_in(lines.column("pos"), value_set=gone.combine_chunks())))
        side = side.filter(pc.is_valid(side.column("code")))
    lists = lines.column("codes").combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = side.take(pc.sort_indices(side.column("code"))).column("value").combine_chunks()
    return lines.column("doc_id"), size, lists.flatten().to_numpy(zero_copy_only=False), values


def _sums(size: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The sum of ``each`` over runs of the given sizes, which may be empty."""
    total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    ends = np.cumsum(size, dtype=np.int64)
    return total[ends] - total[ends - size]


def _encoded(lines: pa.Table, side: pa.Table) -> pa.Table:
    doc_ids, size, codes, values = _placed(lines, side)
    flat, length = values.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(values).to_numpy(zero_copy_only=False)
    start = np.cumsum(length, dtype=np.int64) - length
    many = length[codes] if len(codes) else np.zeros(0, dtype=np.int64)
    # the place in flat of every token: its word's start and its number within the word
    before = np.cumsum(many, dtype=np.int64) - many
    places = np.arange(int(many.sum()), dtype=np.int64) + np.repeat((start[codes] if len(codes) else many) - before, many)
    offsets = np.concatenate([[0], np.cumsum(_sums(size, many))]).astype(np.int32)
    ids = pa.ListArray.from_arrays(offsets, pa.array(flat[places] if len(places) else places, pa.int32()))
    return pa.table({"doc_id": doc_ids, "ids": ids})


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids): the token ids of every document, without special tokens; an empty list for empty and null texts.

    Strings that look like special tokens are ordinary text. A repeated row counts once; doc_id must tell texts apart.
    Texts are read once; a word is shuffled once per chunk that has it, not once per occurrence. Extra columns are dropped.
    """
    return _joined(docs, doc_id, text, folder, "ids", "array<int>", "doc_id long, ids array<int>", _encoded, chunk_words)


def _counted(lines: pa.Table, side: pa.Table) -> pa.Table:
    doc_ids, size, codes, values = _placed(lines, side)
    length = values.to_numpy(zero_copy_only=False)
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(_sums(size, length[codes] if len(codes) else np.zeros(0, dtype=np.int64)), pa.int64())})


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens): the number of ids of every document, 0 for empty and null texts; a repeated row counts once."""
    return _joined(docs, doc_id, text, folder, "size(ids)", "int", "doc_id long, n_tokens long", _counted, CHUNK_WORDS)


def pieces(spark: SparkSession, folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece): the vocabulary, a fixed number of rows; piece is the token's bytes in hexadecimal digits."""
    rows = [(i, b.hex()) for b, i in _ranks(folder).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode(encoded: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids), by a join with the vocabulary; empty lists give empty texts."""
    ids = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(encoded.sparkSession, folder)), "id")
    every = encoded.select("doc_id", F.lit(-1).alias("pos"), F.lit("").alias("piece"))
    whole = ids.select("doc_id", "pos", "piece").unionByName(every).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "piece"))).alias("w"))
    return whole.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("w", lambda x: x["piece"]), "")), "UTF-8").alias("text"))
