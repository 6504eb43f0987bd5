"""Problem 5: the frequency of every distinct term.

Pairs of term and record are range-partitioned and sorted externally by Spark; a scan over
the sorted runs counts occurrences and distinct records. A term that is in most records
takes as many partitions as its share of the pairs, since ranges go by term and record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.terms import TERM_BYTES, records_with_terms, term_rows
from chunkwright.operators.skew import partitions_for

#: Rarer than this, or in a larger share of the records, and a term is of no use.
RARE_ROWS = 2
COMMON_PERMILLE = 600


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, rows) for each run of a partition sorted by (term, record); a run may go on in the next batch."""
    term, record, occurrences, rows = None, None, 0, 0
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("rows", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, records = batch.column(0), batch.column(1)
        runs = pc.run_end_encode(terms, run_end_type=pa.int32())
        ends = runs.run_ends.to_numpy()
        starts = np.concatenate(([0], ends[:-1]))
        values = runs.values.cast(pa.string())
        new = np.ones(batch.num_rows, np.int64)
        new[1:] = pc.not_equal(records.slice(1), records.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[starts] = 1
        n_all, n_rows = ends - starts, np.add.reduceat(new, starts)
        if term == values[0].as_py():
            n_all[0] += occurrences
            n_rows[0] += rows - (record == records[0].as_py())
        elif term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([occurrences]), pa.array([rows])], schema=schema)
        last = len(values) - 1
        if last:
            yield pa.RecordBatch.from_arrays([values.slice(0, last), pa.array(n_all[:-1].astype(np.int64)), pa.array(n_rows[:-1])], schema=schema)
        term, record, occurrences, rows = values[last].as_py(), records[-1].as_py(), int(n_all[-1]), int(n_rows[-1])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([occurrences]), pa.array([rows])], schema=schema)


def term_frequencies(df: DataFrame, key: str = "chunk_no", text: str = "text", rare_rows: int = RARE_ROWS, common_permille: int = COMMON_PERMILLE) -> DataFrame:
    """(term, occurrences, rows, mark) for every distinct term; ``mark`` is rare, common or useful.

    Rare: in ``rare_rows`` records at most; common: in more than ``common_permille``
    thousandths of the records that have a term (and not rare). Rows that share a key are
    one record. Null and empty texts and null keys add nothing; an empty table has no terms.
    """
    known = df.where(F.col(key).isNotNull())
    pairs = term_rows(known, key, text).select("term", key)
    runs = pairs.repartitionByRange(partitions_for(known.select(key, text), TERM_BYTES), "term", key).sortWithinPartitions("term", key).mapInArrow(run_lengths, "term string, occurrences bigint, rows bigint")
    whole = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("rows").alias("rows"))
    n = records_with_terms(known, key, text).scalar()
    mark = F.when(F.col("rows") <= rare_rows, "rare").when(F.col("rows") * 1000 > n * common_permille, "common").otherwise("useful")
    return whole.withColumn("mark", mark)
