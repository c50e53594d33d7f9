import pytest
from oracle import SF, same

from strata.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name])


def test_pilot_cover_is_greedy(spark):
    from pyspark.sql import functions as F

    picks = [r["user_id"] for r in catalogue.queries()["pilot_cover"](spark, SF).orderBy("pick").collect()]
    has: dict[int, set] = {}
    for r in catalogue.read(spark, SF, "events").select("user_id", F.concat_ws(":", "event_type", F.hour("ts").cast("string")).alias("f")).collect():
        has.setdefault(r["user_id"], set()).add(r["f"])
    want, covered = [], set()
    for family in (0, 1, None, None, None, None, None, None, None, None):
        left = [u for u in has if u not in want and (family is None or u % 2 == family)]
        want.append(min(left, key=lambda u: (-len(has[u] - covered), -len(has[u]), u)))
        covered |= has[want[-1]]
    assert picks == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "unit_no", "token_estimate", "preview"]
