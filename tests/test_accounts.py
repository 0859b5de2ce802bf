from datetime import datetime

import pytest
from pyspark.sql import functions as F

from idloom.operators import accounts as ac

T = [datetime(2024, 1, d) for d in range(1, 6)]
ACC = "id long, username string, is_active boolean, registered_at timestamp, activated_at timestamp"


def test_users_roles_and_requests(spark):
    a = spark.createDataFrame([(1, "zed", True, T[0], T[0]), (2, "amy", False, None, None), (3, "bob", False, T[0], None), (4, "cat", False, T[0], T[1])], ACC)
    r = spark.createDataFrame([(1, "Admin "), (1, "reader"), (1, "reader"), (3, "nope")], "user_id long, role string")
    q = spark.createDataFrame([(1, 1, "pending", T[0]), (2, 1, "blocked", T[1]), (3, 1, "approved", T[1])], "id long, user_id long, status string, requested_at timestamp")
    rows = ac.list_users(a, r, q).collect()
    assert [(x.username, x.user_status, x.roles) for x in rows] == [("amy", "invited", []), ("bob", "pending_activation", []), ("cat", "inactive", []), ("zed", "active", ["admin", "reader"])]
    assert rows[3].removal_request.request_id == 3 and rows[0].removal_request is None
    assert ac.latest_request(q, "pending").first().id == 1
    has = {x.id: (x.a, x.c) for x in ac.list_users(a, r, q).select("id", ac.has_role(F.col("roles"), "curator").alias("a"), ac.has_role(F.col("roles"), "reader").alias("c")).collect()}
    assert has[1] == (True, True) and has[2] == (False, False)
    assert {tuple(x) for x in ac.set_roles(r, 1, ["Curator", "curator"]).collect()} == {(3, "nope"), (1, "curator")}
    with pytest.raises(ValueError):
        ac.set_roles(r, 1, ["boss"])
    assert ac.list_users(a.limit(0), r, q).collect() == []


def test_sessions(spark):
    a = spark.createDataFrame([(1, "u", True, T[0], T[0]), (2, "v", False, T[0], T[0])], ACC)
    s = spark.createDataFrame([(1, "a", T[4], None), (1, "b", T[4], T[0]), (1, "c", T[1], None), (2, "d", T[4], None)], "user_id long, token_hash string, expires_at timestamp, revoked_at timestamp")
    now = F.lit(T[2])
    assert [x.token_hash for x in ac.live_sessions(s, a, now).collect()] == ["a"]
    left = ac.revoke(s, 1, now, keep_token="a")
    assert {x.token_hash for x in left.where("revoked_at is null").collect()} == {"a", "d"}
    assert spark.createDataFrame([("  Bob ",)], "n string").select(ac.user_name(F.col("n"))).first()[0] == "bob"
