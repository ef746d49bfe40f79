import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from msgsearch.schemas import DOCUMENT  # noqa: E402
from msgsearch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        spark_sql_shuffle_partitions="4",
        spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = dict(
    id=None,
    chat_id=8801,
    message_id=1,
    session_name="north",
    text="harvest notes",
    sender_id=17,
    sender_name="Ines",
    receiver_name="Tomas",
    date=1650000000,
    chat_title="Garden Club",
)


@pytest.fixture
def documents(spark):
    """Build a document frame from keyword rows; the id follows from the other keys."""

    def build(*rows):
        full = [{**DEFAULTS, **row} for row in rows]
        for row in full:
            row["id"] = f"{row['session_name']}:{row['chat_id']}:{row['message_id']}"
        return spark.createDataFrame([tuple(r[c] for c in DOCUMENT.fieldNames()) for r in full], DOCUMENT)

    return build


@pytest.fixture
def new_index(spark):
    """A fresh index; tables are dropped afterwards, files stay in the shared folder."""
    import uuid

    from msgsearch.session import scratch_dir
    from msgsearch.sources.index_store import _TABLES, MessageIndex

    opened = []

    def build(**options):
        name = f"t_{uuid.uuid4().hex}"
        index = MessageIndex(spark, scratch_dir(spark, "index"), name, **options).open()
        opened.append(index)
        return index

    yield build
    for index in opened:
        for kind in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {index.table_name(kind)}")
