"""The query of neighbours by index asks for every player, not for a share of them."""

from seasonforge.plans import base, catalogue

SF = "/root/testdata/sf0.001"


def test_every_player_is_asked(spark):
    f, sql = catalogue.QUERIES["j21_nearest_by_index"]
    got = {(r.player_id, r.season) for r in f(spark, SF).collect()}
    rows = [(r.player_id, r.season, r.position) for r in base.seasons(spark, SF).collect()]
    want = {(p, y) for p, y, at in rows if at is not None and any(o != p and a == at for o, _, a in rows)}
    assert got == want and any(p % 50 for p, _ in got)
    assert "%" not in sql[sql.index("FROM z a JOIN z b") :]
