import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder for checkpoints and written tables."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return sc.getCheckpointDir()


@pytest.fixture
def docs_of(spark, shared):
    """Documents from (doc_id, text[, lang, source]), with columns whose names the
    operators use inside."""

    def make(rows):
        rows = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
        rows = [(i, t, la, so, None if t is None else len(t), 1, 2, "x") for i, t, la, so in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, _row int, size int, fp string"
        return spark.createDataFrame(rows, kinds)

    return make
