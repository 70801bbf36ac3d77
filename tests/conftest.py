import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from schemaweft.session import local_session  # noqa: E402

CATALOG = "pair_id string, side string, ordinal bigint, name string, dtype string"

SYNTHETIC_SOURCE = "id name email address_line_1 address_line_2 created_at amount status".split()
SYNTHETIC_TARGET = (
    "CUST_D CUST_NM1 CUST_NM2 CUST_ML CUST_STRS CUST_CRTD_T CUST_MNT LEGACY_FLAG INTERNAL_CODE MIGRATION_BATCH"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def catalog_of(spark):
    """Catalog from {pair: (source names, target names)}; names may be (name, dtype)."""

    def build(pairs):
        rows = []
        for pair, sides in pairs.items():
            for side, names in zip(("source", "target"), sides):
                for i, name in enumerate(names):
                    name, dtype = name if isinstance(name, tuple) else (name, "str")
                    rows.append((pair, side, i + 1, name, dtype))
        return spark.createDataFrame(rows, CATALOG)

    return build


@pytest.fixture
def ranked_lists():
    """{(pair, src_ord): [(tgt, score), ...]} of predictions, best first."""

    def build(predictions):
        out = {}
        for r in predictions.collect():
            out.setdefault((r.pair_id, r.src_ord), []).append((r["rank"], r.tgt, r.score))
        return {key: [(t, s) for _, t, s in sorted(rows)] for key, rows in out.items()}

    return build
