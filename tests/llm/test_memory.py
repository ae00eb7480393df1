import pyarrow as pa
import pytest

from twinleaf.llm import line_dedup, shared, textvec, tokens

ARROW, PARQUET = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
TEXTS = ["a b\nc", "c\nd"]


def deal():
    """A task of line_dedup, as a worker runs it."""
    return list(line_dedup._deal_hashes(iter([pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["t"])]), bits=4, min_chars=1))


@shared.frugal
def _encode(path):
    for _, _, ids, _ in tokens.encoded(pa.array(TEXTS), path, 2):
        yield ids.tolist()


@shared.frugal
def _other_step():
    yield 1


def test_line_dedup_drops_the_tokenizers_of_an_earlier_operator():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    first = list(_encode(path))
    loaded = tokens.ChunkedTokenizer._loaded[path]
    assert list(_other_step()) and list(_encode(path)) == first
    assert tokens.ChunkedTokenizer._loaded[path] is loaded  # kept for tasks and steps of one operator
    rows = deal()
    assert not tokens.ChunkedTokenizer._loaded
    assert list(_encode(path)) == first and deal() == rows


def test_line_dedup_drops_the_powers_of_longer_texts():
    @shared.frugal
    def long_texts():
        yield len(textvec._power_tables(1 << 20)[0])

    assert list(long_texts()) == [1 << 20]
    deal()
    assert len(textvec._powers["p"]) == 1 << 16


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    fresh = spark.newSession()
    shared.ship(fresh)
    assert (fresh.conf.get(ARROW), fresh.conf.get(PARQUET)) == (str(shared.BATCH_ROWS), str(shared.READ_ROWS))
    own = spark.newSession()
    own.conf.set(PARQUET, "2000")
    shared.ship(own)
    assert (own.conf.get(ARROW), own.conf.get(PARQUET)) == (str(shared.BATCH_ROWS), "2000")
