"""Which study a caller gets, and what that costs."""

import pytest

from holdfast.plans import retention
from holdfast.sources import tables


@pytest.fixture
def source(spark, tmp_path, make_raw):
    """A raw table of two files, how often it was opened, and a clock."""
    path = str(tmp_path / "raw")
    make_raw({}, {"Customer_Age": 30}).repartition(2).write.parquet(path)
    opened, clock = [], [0.0]

    def get():
        raw = lambda: opened.append(1) or spark.read.parquet(path)
        return retention.study(spark, path, raw, [], lambda: [path], lambda: clock[0])

    return path, opened, clock, get


def test_a_source_is_opened_once(source):
    _, opened, clock, get = source
    first = get()
    assert get() is first and len(opened) == 1
    clock[0] += retention.TRUSTED + 1
    assert get() is first and len(opened) == 1  # compared, and found unchanged


def test_a_changed_source_gets_a_study_of_its_own(spark, source, make_raw):
    path, opened, clock, get = source
    first = get()
    assert first.customers.count() == 2
    make_raw({"CLIENTNUM": 9}).write.mode("append").parquet(path)
    clock[0] += retention.TRUSTED + 1
    second = get()
    assert second is not first and len(opened) == 2 and second.customers.count() == 3


def test_refresh_compares_at_once(spark, source, make_raw):
    path, _, _, get = source
    first = get()
    make_raw({"CLIENTNUM": 9}).write.mode("overwrite").parquet(path)
    assert get() is first
    retention.refresh(spark)
    assert get().customers.count() == 1


def test_very_many_files_cost_no_call_per_file(spark, tmp_path, monkeypatch):
    """A folder of 1,000 files, some in folders of their own: nothing is asked for file by file."""
    for k in range(1_000):
        folder = tmp_path / "many" / f"part={k % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.parquet").write_bytes(b"x" * (1 + k % 7))
    calls = []
    client = spark.sparkContext._gateway._gateway_client
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **b: calls.append(1) or send(*a, **b))
    before = tables.files_state(spark, [str(tmp_path / "many")])
    assert before[:2] == (1_000, sum(1 + k % 7 for k in range(1_000))) and len(calls) < 500
    (tmp_path / "many" / "part=3" / "3.parquet").write_bytes(b"y" * 9)
    assert tables.files_state(spark, [str(tmp_path / "many")]) != before
