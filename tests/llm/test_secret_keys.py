"""Keys of any length and of one case are parts when a complement is in scope."""

from seasonforge.llm import secrets


def test_long_and_single_case_keys(spark):
    keys = ["aB3" + "xYz9" * 15 + "q", "aB3" + "x/z+" * 20 + "QWE", "aB3" + "xYz9" * 100, "ABCDEFGH234567" * 3]
    assert [len(k) for k in keys[:2]] == [64, 86]
    rows = [(i, f"account: shop {k}==" if i % 2 else f"account: shop {k}") for i, k in enumerate(keys)]
    rows += [(10, f"only {keys[1]}=="), (11, "account: shop " + "k" * 50), (12, "account: shop some/path/to/a/file/2/below/another/folder")]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, k in enumerate(keys):
        assert got[i] == f"login:0:13,key:14:{14 + len(k)}", i
    assert got[10] == got[11] == got[12] == ""
