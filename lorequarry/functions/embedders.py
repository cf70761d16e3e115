"""Embedders and tokenizers: the plug-in points. Each gives a column; models are loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, check_windows
from ..errors import KnowledgeError
from . import text, vectors


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, content: Column, position: Column) -> Column: ...


class Tokenizer(Protocol):
    """chunks(): (idx, content, token_count, start) of windows; start is where content begins, in code points.

    encode() gives the ids of a text's tokens, decode() the text of ids; vocab_size is the number of ids, or None for a
    tokenizer without a vocabulary, whose encode() and decode() are errors.
    """

    name: str
    vocab_size: int | None

    def encode(self, content: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...

    def chunks(self, content: Column, max_tokens: int, overlap_tokens: int) -> Column: ...


class MockEmbedder:
    """One-hot by position in the batch; no model, and no regard for the text."""

    name = "mock"

    def __init__(self, dimension: int = 8, batch_size: int = 32):
        self.dimension, self.batch_size = dimension, batch_size

    def embed(self, content: Column, position: Column) -> Column:
        return vectors.one_hot(position, self.dimension, self.batch_size)


class HashingEmbedder:
    """Signed counts of hashed index terms, normalised: texts that share terms are alike. The default, as it needs no model."""

    name = "hashing"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, content: Column, position: Column) -> Column:
        dimension = self.dimension

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def summed(codes):
            import numpy as np
            import pandas as pd

            lists = [np.asarray(c if c is not None else (), np.int64) for c in codes]
            owner = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
            flat = np.concatenate([*lists, np.empty(0, np.int64)])
            v = np.bincount(owner * dimension + flat % dimension, 1.0 - 2.0 * (flat // dimension % 2), len(lists) * dimension).reshape(-1, dimension)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            return pd.Series(list((v / np.where(size > 0, size, 1)).astype(np.float32)))

        # terms are hashed in the JVM; of a batch all are summed at once
        return summed(F.transform(text.analyzed(content), lambda t: F.crc32(F.encode(t, "UTF-8"))))


class OnnxEmbedder:
    """A sentence-embedding model in a file that every executor can read; its output sentence_embedding, normalised."""

    name = "onnx"

    def __init__(self, model_path: str, tokenizer_path: str, dimension: int = 1024, max_tokens: int = 8192, batch_size: int = 32):
        self.model_path, self.tokenizer_path, self.dimension, self.max_tokens, self.batch_size = model_path, tokenizer_path, dimension, max_tokens, batch_size

    def embed(self, content: Column, position: Column) -> Column:
        model_path, tokenizer_path, limit, size = self.model_path, self.tokenizer_path, self.max_tokens, self.batch_size

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches):
            import numpy as np
            import onnxruntime
            import pandas as pd
            from tokenizers import Tokenizer as Rules

            rules, session = Rules.from_file(tokenizer_path), onnxruntime.InferenceSession(model_path)
            rules.enable_truncation(limit)
            wanted = {i.name for i in session.get_inputs()}
            for series in batches:
                out = []
                for at in range(0, len(series), size):
                    ids = [e.ids for e in rules.encode_batch([t or "" for t in series[at : at + size]], add_special_tokens=False)]
                    width = max(1, max(map(len, ids)))
                    fed = np.array([i + [0] * (width - len(i)) for i in ids], np.int64)
                    mask = np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids], np.int64)
                    feed = {"input_ids": fed, "attention_mask": mask, "token_type_ids": np.zeros_like(fed)}
                    v = session.run(["sentence_embedding"], {k: x for k, x in feed.items() if k in wanted})[0]
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    out += list(np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32))
                yield pd.Series(out)

        from collections.abc import Iterator

        import pandas as pd

        run.func.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run.func, T.ArrayType(T.FloatType()))(content)


class WhitespaceTokenizer:
    """Tokens are runs of non-space. All in the JVM."""

    name, vocab_size = "whitespace", None

    def encode(self, content: Column) -> Column:
        raise KnowledgeError("E_VALIDATION", "the white-space tokenizer has no vocabulary")

    decode = encode

    def chunks(self, content: Column, max_tokens: int, overlap_tokens: int) -> Column:
        made = text.windows(text.whitespace_tokens(content), max_tokens, overlap_tokens, starts=True)
        lead = F.length(F.regexp_extract(content, r"^\s*", 0))
        return F.transform(made, lambda w: w.withField("start", w["start"] + lead))


CHUNKS = T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.LongType()), T.StructField("start", T.LongType())]))


#: Characters, or ids, that a tokenizer takes at once, about: what the library holds for each token is far larger than the text.
AT_ONCE = 1 << 18


def parted(items: list, limit: int | None = None) -> Iterator[list]:
    """items in runs of about `limit` characters (or ids) together; one that is longer is alone or ends a run."""
    limit, held, size = limit or AT_ONCE, [], 0
    for item in items:
        held.append(item)
        size += len(item)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def rules_of(path: str):
    """The tokenizer of a file, to be used by the one core of a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Rules

    return Rules.from_file(path)


class FileTokenizer:
    """A tokenizer.json that every executor can read; windows are cut at its tokens' offsets."""

    def __init__(self, path: str):
        self.path, self.name = path, f"file:{path.rsplit('/', 1)[-1]}"

    @property
    def vocab_size(self) -> int:
        from tokenizers import Tokenizer as Rules

        return Rules.from_file(self.path).get_vocab_size()

    def encode(self, content: Column) -> Column:
        """The ids of a text as array<int>, in batches, without tokens that mark begin or end; null for a null text."""
        path = self.path

        def run(batches):
            import numpy as np
            import pyarrow as pa

            rules = rules_of(path)
            for batch in batches:
                lengths, flat = [], []
                for texts in parted([t or "" for t in batch.to_pylist()]):
                    for ids in (e.ids for e in rules.encode_batch_fast(texts, add_special_tokens=False)):
                        lengths.append(len(ids))
                        flat.append(np.asarray(ids, np.int32))
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), pa.int32(), mask=np.r_[batch.is_null().to_numpy(zero_copy_only=False), False])
                yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*flat, np.empty(0, np.int32)])))

        return F.arrow_udf(annotated(run), "array<int>")(content)

    def decode(self, ids: Column) -> Column:
        """The text of ids, special tokens among them; null for null ids."""
        path = self.path

        def run(batches):
            import pyarrow as pa

            rules = rules_of(path)
            for batch in batches:
                texts, held, size = [], [], 0
                for ids in batch:
                    held.append(ids.as_py() or [])
                    size += len(held[-1])
                    if size >= AT_ONCE:
                        texts += rules.decode_batch(held, skip_special_tokens=False)
                        held, size = [], 0
                texts += rules.decode_batch(held, skip_special_tokens=False)
                yield pa.array(texts, pa.string(), mask=batch.is_null().to_numpy(zero_copy_only=False))

        return F.arrow_udf(annotated(run), "string")(ids)

    def chunks(self, content: Column, max_tokens: int, overlap_tokens: int) -> Column:
        check_windows(max_tokens, overlap_tokens)
        path, step = self.path, max_tokens - overlap_tokens

        def cut(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            rules, made = rules_of(path), to_arrow_type(CHUNKS)
            for batch in batches:
                out = []
                for texts in parted([t or "" for t in batch.to_pylist()]):
                    for text_, encoded in zip(texts, rules.encode_batch(texts, add_special_tokens=False)):
                        spans, rows, start = encoded.offsets, [], 0
                        while start < len(spans):
                            end = min(start + max_tokens, len(spans))
                            rows.append({"idx": len(rows), "content": text_[spans[start][0] : spans[end - 1][1]], "token_count": end - start, "start": spans[start][0]})
                            if end == len(spans):
                                break
                            start += step
                        out.append(rows)
                yield pa.array(out, made)

        return F.arrow_udf(annotated(cut), CHUNKS)(content)


def annotated(run):
    """run as an Arrow function of batches; pyarrow is loaded only where one is made."""
    from collections.abc import Iterator

    import pyarrow as pa

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def embedder_for(config: Config) -> Embedder:
    e = config.embedding
    if "mock" in (e.onnx_path, e.model):
        return MockEmbedder(e.dimension or 8, e.batch_size)
    if e.onnx_path != "auto":
        if e.tokenizer == "auto":
            raise KnowledgeError("E_EMBEDDING", "an ONNX model needs embedding.tokenizer")
        return OnnxEmbedder(e.onnx_path, e.tokenizer, e.dimension or 1024, e.max_input_tokens or 8192, e.batch_size)
    return HashingEmbedder(e.dimension or 64)


def tokenizer_for(config: Config) -> Tokenizer:
    return WhitespaceTokenizer() if config.embedding.tokenizer == "auto" else FileTokenizer(config.embedding.tokenizer)


def with_chunks(documents: DataFrame, tokenizer: Tokenizer, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """documents with a column chunks."""
    return documents.withColumn("chunks", tokenizer.chunks(F.col("content"), max_tokens, overlap_tokens))
