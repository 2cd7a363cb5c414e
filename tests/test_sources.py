from datetime import date, datetime

import pytest

from platewise.plans.reporting import run
from platewise.schemas import TABLES
from platewise.sources.readers import broken_records, read_raw_orders, read_table
from platewise.sources.writers import save_table, write_csv, write_scalar
from tests.test_edges import GOOD


def text(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_typed_load(spark, tmp_path, rows):
    path = tmp_path / "users.csv"
    path.write_bytes(
        b"user_id,signup_date,city_tier,platform,acquisition_channel,is_power_user\r\n"
        b'U1,2024-01-05,"Metro, old",iOS,,True\r\nU2,,Tier-1,Android,social,False\r\nU3,bad,x,y,z,\r\n'
    )
    assert rows(read_table(spark, str(path), "synthetic_users")) == [
        ("U1", date(2024, 1, 5), "Metro, old", "iOS", None, True),
        ("U2", None, "Tier-1", "Android", "social", False),
        ("U3", None, "x", "y", "z", False),
    ]


def test_order_columns_are_read_by_position(spark, tmp_path, rows):
    path = tmp_path / "orders.csv"
    path.write_text("session_id,user_id,order_ts,order_value,order_id\nS1,U1,2024-01-02 10:00:40,425.5,O100000\r\n")
    assert rows(read_table(spark, str(path), "synthetic_orders")) == [
        ("S1", "U1", datetime(2024, 1, 2, 10, 0, 40), 425.5, "O100000")
    ]


@pytest.mark.parametrize("name", sorted(TABLES))
def test_round_trip(spark, tmp_path, name, rows):
    values = {"string": "a,\"b", "double": 1.25, "int": 3, "boolean": True, "date": date(2024, 2, 29),
              "timestamp_ntz": datetime(2024, 2, 29, 23, 59, 1)}
    full = tuple(values[f.dataType.simpleString()] for f in TABLES[name].fields)
    empty = tuple(False if f.dataType.simpleString() == "boolean" else None for f in TABLES[name].fields)
    df = spark.createDataFrame([full, empty], TABLES[name])
    for _ in range(2):  # writing again replaces
        write_csv(df, str(tmp_path / name), single_file=True)
    assert sorted(rows(read_table(spark, str(tmp_path / name), name)), key=repr) == sorted([full, empty], key=repr)


def test_scalar_sink(spark, tmp_path):
    write_scalar(spark.sql("SELECT 0.701645 AS overall_on_time_pct"), str(tmp_path / "s"))
    assert text(tmp_path / "s") == "overall_on_time_pct=0.7016\n"


def test_saved_table_is_replaced(spark):
    for n in (3, 2):
        save_table(spark.range(n), "reloaded")
    assert spark.table("reloaded").count() == 2
    spark.sql("DROP TABLE reloaded")


def test_raw_orders_keep_their_text(spark, tmp_path, rows):
    (tmp_path / "raw.csv").write_text(" ID ,Age\n 1 ,NaN \n")
    df = read_raw_orders(spark, str(tmp_path / "raw.csv"))
    assert df.columns == [" ID ", "Age"] and rows(df) == [(" 1 ", "NaN ")]


def test_whole_report(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (tmp_path / "raw.csv").write_text("\n".join([",".join(GOOD), ",".join(GOOD.values()), ",".join(GOOD.values())]) + "\n")
    (data / "synthetic_users.csv").write_text(
        "user_id,signup_date,city_tier,platform,acquisition_channel,is_power_user\nU1,2024-01-05,Metro,iOS,organic,False\n"
    )
    (data / "synthetic_funnel_events.csv").write_text(
        "session_id,user_id,event_ts,stage,stage_order\nS1,U1,2024-01-06 10:00:00,app_open,0\nS1,U1,2024-01-06 10:00:20,browse,1\n"
    )
    (data / "synthetic_orders.csv").write_text("session_id,user_id,order_ts,order_value,order_id\nS1,U1,2024-01-06 10:01:00,425.5,O1\n")
    (data / "synthetic_ab_test.csv").write_text(
        "checkout_session_id,arm,checkout_start_ts,order_placed\nA1,control,2024-09-01 00:00:00,True\nA2,treatment,2024-09-01 00:00:00,False\n"
    )
    out = tmp_path / "out"
    shared = tmp_path / "shared"
    shared.mkdir()
    run(spark, str(tmp_path / "raw.csv"), str(data), str(out), date(2024, 9, 30), str(shared))
    assert list(shared.iterdir()) == []
    tables = out / "tables"
    assert text(tables / "delivery_overall_on_time") == "overall_on_time_pct=1.0000\n"
    assert text(tables / "funnel_first_session").splitlines()[1:3] == ["app_open,1,1.0,0.0,1.0", "browse,1,1.0,0.0,1.0"]
    assert text(tables / "cohort_retention_by_month").splitlines()[1] == "2024-01,1,1.0,1,0.0,1,0.0,1"
    assert text(tables / "row_counts").splitlines()[1:] == [
        "real_orders,2", "synthetic_users,1", "synthetic_funnel_events,2", "synthetic_orders,1", "synthetic_ab_test,2",
    ]
    assert len(list(tables.iterdir())) == 31
    assert text(tables / "rows_in_and_out").splitlines()[1] == "2,2"
    found = [line.split(",") for line in text(tables / "constraint_violations").splitlines()[1:]]
    assert sorted(line[-1] for line in found if line[0] == "real_orders") == ["0", "1"]  # the same record twice
    assert text(tables / "dau").splitlines()[1:] == ["2024-01-06,1"]


def test_quoted_raw_fields(spark, tmp_path, rows):
    (tmp_path / "raw.csv").write_text('a,b\n"say ""hi"", ok",1\n"two\nlines",2\n')
    assert rows(read_raw_orders(spark, str(tmp_path / "raw.csv"), multi_line=True)) == [('say "hi", ok', "1"), ("two\nlines", "2")]
    (tmp_path / "one.csv").write_text('a,b\n"say ""hi"", ok",1\n')
    assert rows(read_raw_orders(spark, str(tmp_path / "one.csv"))) == [('say "hi", ok', "1")]


HEADER = "user_id,signup_date,city_tier,platform,acquisition_channel,is_power_user"


def test_line_breaks_inside_quotes(spark, tmp_path, rows):
    (tmp_path / "u.csv").write_text(f'{HEADER}\nU1,2024-01-05,"Metro\nold",iOS,,True\n')
    assert rows(read_table(spark, str(tmp_path / "u.csv"), "synthetic_users", multi_line=True)) == [
        ("U1", date(2024, 1, 5), "Metro\nold", "iOS", None, True)
    ]


def test_header_names_are_checked(spark, tmp_path, rows):
    swapped = HEADER.replace("city_tier,platform", "platform,city_tier")
    (tmp_path / "u.csv").write_text(f"{swapped}\nU1,2024-01-05,iOS,Metro,,True\n")
    with pytest.raises(ValueError, match="platform"):
        read_table(spark, str(tmp_path / "u.csv"), "synthetic_users")
    assert rows(read_table(spark, str(tmp_path / "u.csv"), "synthetic_users", by_position=True))[0][2] == "iOS"


def test_broken_records_are_counted(spark, tmp_path):
    (tmp_path / "u.csv").write_text(f"{HEADER}\nU1,2024-01-05,Metro,iOS,,True\nU2,2024-01-05\nU3,2024-01-05,Metro,iOS,,True,more\n")
    read = read_table(spark, str(tmp_path / "u.csv"), "synthetic_users", broken="broken").cache()
    assert broken_records(read, "broken").first()[0] == 2
    assert [r.user_id for r in read.filter("broken IS NULL").collect()] == ["U1"]


def test_every_file_of_a_folder_must_have_the_header(spark, tmp_path, rows):
    folder = tmp_path / "users"
    folder.mkdir()
    for ending in ("\n", "\r\n"):
        (folder / "a.csv").write_bytes(f"{HEADER}{ending}U1,2024-01-05,Metro,iOS,,True{ending}".encode())
        (folder / "b.csv").write_bytes(f"{HEADER}{ending}U2,2024-01-06,Metro,iOS,,False{ending}".encode())
        assert sorted(r[0] for r in rows(read_table(spark, str(folder), "synthetic_users"))) == ["U1", "U2"]
        swapped = HEADER.replace("city_tier,platform", "platform,city_tier")
        (folder / "b.csv").write_bytes(f"{swapped}{ending}U2,2024-01-06,iOS,Metro,,False{ending}".encode())
        with pytest.raises(Exception, match="(?i)header|has the columns"):
            rows(read_table(spark, str(folder), "synthetic_users"))
        assert len(rows(read_table(spark, str(folder), "synthetic_users", by_position=True))) == 2


def test_raw_files_must_share_their_header_and_show_broken_records(spark, tmp_path, rows):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("ID ,Age\n1 ,NaN \n2\n")
    (folder / "b.csv").write_text("ID ,Age\n3,4,5\n6,7\n")
    read = read_raw_orders(spark, str(folder), broken="broken")
    assert read.columns == ["ID ", "Age", "broken"]
    assert sorted(r.broken for r in read.cache().collect() if r.broken) == ["2", "3,4,5"]
    assert broken_records(read, "broken").first()[0] == 2
    (folder / "b.csv").write_text("Age,ID \n4,3\n")
    with pytest.raises(Exception, match="(?i)header|has the columns"):
        rows(read_raw_orders(spark, str(folder)))


@pytest.mark.parametrize("multi_line", [False, True])
def test_header_with_a_byte_order_mark_and_carriage_returns(spark, tmp_path, rows, multi_line):
    (tmp_path / "u.csv").write_bytes(f"\ufeff{HEADER}\r\nU1,2024-01-05,Metro,iOS,,True\r\n".encode())
    assert rows(read_table(spark, str(tmp_path / "u.csv"), "synthetic_users", multi_line=multi_line)) == [
        ("U1", date(2024, 1, 5), "Metro", "iOS", None, True)
    ]
    (tmp_path / "u.csv").write_bytes(f"{HEADER.replace('iOS', 'x').replace('platform', 'plat')}\r\nU1,2024-01-05,Metro,iOS,,True\r\n".encode())
    with pytest.raises(ValueError, match="plat"):
        rows(read_table(spark, str(tmp_path / "u.csv"), "synthetic_users", multi_line=multi_line))
