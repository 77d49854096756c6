"""One tokenizer for corpus and queries, and the posting table it feeds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Latin words and numbers, or one CJK character.
TOKEN = r"[\p{IsLatin}\p{Nd}]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
_TOKEN = r"[\p{IsLatin}\p{Nd}]+|[㐀-䶿一-鿿]"
#: Characters of the texts that are tokenised at a time.
CHARACTERS = 1 << 22


def tokens(text: str | Column, dictionary: list[str] | Column | None = None) -> Column:
    """Lower-cased tokens in order; dictionary terms that occur in the text are added at the end (full cut)."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    if dictionary is not None:
        found = F.concat(found, F.filter(_terms(dictionary), lambda t: c.contains(t) & ~F.array_contains(found, t)))
    return found


def _terms(dictionary: list[str] | Column) -> Column:
    return dictionary if isinstance(dictionary, Column) else F.array(*[F.lit(t.lower()) for t in dictionary]).cast("array<string>")


def grouped(lists: list[list[str]]) -> tuple[np.ndarray, list[str], pa.ListArray]:
    """(number of the list, token, its positions in it from 1) for every distinct token of every list."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    row = np.repeat(np.arange(len(lists)), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    code, names = pd.factorize(np.fromiter(chain.from_iterable(lists), dtype=object, count=len(row)))
    key = row * max(1, len(names)) + code
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, dtype=np.int64)
    first = order[starts]
    spots = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(position[order].astype(np.int32)))
    return row[first], names[code[first]].tolist(), spots


def postings(rows: DataFrame, keys: str | list[str], text: str, dictionary: list[str] | Column | None = None) -> DataFrame:
    """(keys, token, positions): one row per token of a row, positions ascending from 1.

    A row holds all its tokens, so they are grouped inside it, a batch of rows at a time; nothing is shuffled.
    """
    ship(rows.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys
    terms = F.array().cast("array<string>") if dictionary is None else F.coalesce(_terms(dictionary), F.array().cast("array<string>"))
    asked = rows.select(*keys, F.lower(text).alias("_text"), terms.alias("_terms"))  # names of its own: the keys may have any
    kinds = ", ".join(f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(_TOKEN).findall
        for batch in batches:
            n, begin = len(keys), 0
            while begin < batch.num_rows:
                lists, end, size = [], begin, 0
                while end < batch.num_rows and size < CHARACTERS:
                    t = batch.column(n)[end].as_py() or ""
                    found = find(t)
                    more = batch.column(n + 1)[end].as_py()
                    if more:
                        known = set(found)
                        found += [x for x in more if x not in known and x in t]
                    lists.append(found)
                    size, end = size + len(t), end + 1
                at, names, spots = grouped(lists)
                own = batch.slice(begin, end - begin).select(range(n)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), spots], names=[*keys, "token", "positions"])
                begin = end

    return asked.mapInArrow(run, f"{kinds}, token string, positions array<int>")
