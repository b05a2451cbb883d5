"""Token counts: Arrow batches through a tokenizer, lengths only.

Texts are regrouped into encode calls of about equal bytes, so one batch of long texts costs
no more memory than one of short texts. A text longer than `split_chars` is cut at safe
boundaries and its parts are counted on their own; the count is that of the whole text.

A cut is safe where no token can span it. For a piece model this holds between a non-space
character and a single space followed by a non-space character if no piece of the vocabulary
has a space mark after another character; the vocabulary is checked when the model is loaded,
and texts stay whole if the check fails. The space at the cut is dropped, since the encoder
puts a space mark before each text. For byte-level models texts are not cut.

Nulls and empty texts have 0 bytes and 0 tokens; a null id is kept. Repeated rows are counted each,
so there are no ties. Empty tables give empty results. Columns other than id and text are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handed to the tokenizer in one call.
CALL_BYTES = 1 << 20
#: Texts of more characters than this are cut.
SPLIT_CHARS = 1 << 14

_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def _piece_model(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    # A control or unused piece is never produced from text; any other one may be.
    usable = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i)))
    spans_space = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in usable)
    marks_start = sp.encode("ab ab", out_type=str)[0].startswith("▁")
    return lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)], marks_start and not spans_space


def _json_model(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)], False


def load_counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of texts, whether texts may be cut at `_CUT`) for a .model or .json file."""
    return _piece_model(path) if path.endswith(".model") else _json_model(path)


def split_safely(text: str, split_chars: int = SPLIT_CHARS) -> list[str]:
    """Parts of at least split_chars characters (but the last), cut at single spaces; the spaces go."""
    parts, start = [], 0
    while len(text) - start > split_chars and (cut := _CUT.search(text, start + split_chars)):
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_all(texts: list[str | None], count: Callable, may_cut: bool, call_bytes: int, split_chars: int) -> list[int]:
    """Token counts of texts, in calls of about call_bytes; a part's share of its text's bytes follows its characters."""
    totals, parts, owner, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, n in zip(owner, count(parts), strict=True):
            totals[i] += n
        parts.clear()
        owner.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        wide = len(text.encode("utf-8", "surrogatepass")) / len(text)
        for part in split_safely(text, split_chars) if may_cut else [text]:
            parts.append(part)
            owner.append(i)
            held += len(part) * wide
            if held >= call_bytes:
                flush()
                held = 0
    if parts:
        flush()
    return totals


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, call_bytes: int = CALL_BYTES, split_chars: int = SPLIT_CHARS
) -> DataFrame:
    """Columns: id, n_bytes, n_tokens, over_limit. model_path must be readable on the executors."""
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    id_type = rows.schema["id_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, may_cut = load_counter(model_path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            # Arrow batches hold many rows; texts are decoded in slices of bounded bytes.
            n_tokens, start = [], 0
            while start < batch.num_rows:
                stop, held = start, 0
                while stop < batch.num_rows and (stop == start or held < 8 * call_bytes):
                    held += n_bytes[stop].as_py()
                    stop += 1
                n_tokens += count_all(texts.slice(start, stop - start).to_pylist(), count, may_cut, call_bytes, split_chars)
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64())], ["id_", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"id_ {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id_").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
