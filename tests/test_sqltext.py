import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.functions.sqltext import classify, lex, normalize

PAIRS = [
    ("SELECT * FROM dbo.Users WHERE Id = 42", "select * from dbo.Users where Id = ?"),
    ("SELECT * FROM dbo.Users WHERE Id = 99", "select * from dbo.Users where Id = ?"),
    ("EXEC dbo.GetOrder @OrderId = 123, @Culture = N'fr-FR'", "exec dbo.GetOrder @OrderId = ?, @Culture = ?"),
    ("SELECT 1 -- a comment\nFROM t", "select ? from t"),
    ("SELECT * FROM t WHERE c IN (1, 2, 3)", "select * from t where c in (?)"),
    ("SELECT * FROM [my table] WHERE x = 0x1A", "select * from [my table] where x = ?"),
    ("SELECT * FROM t WHERE s = 'it''s'", "select * from t where s = ?"),
    ("SELECT a /* x /* y */ z */ FROM t WHERE b = -1.5e3", "select a from t where b = -?"),
    ("select x from T order by X DESC", "select x from T order by X DESC"),
    ("SELECT a FROM t WHERE x NOT IN( 'a' ,N'b', 0x1 ) OR y IN (1) OR z IN (a, 1)", "select a from t where x not in (?) or y in (?) or z in (a, ?)"),
    ("SELECT a FROM t WHERE x IN (1, -2) AND f(1, 2) IN (SELECT 1, 2)", "select a from t where x in (?, -?) and f(?, ?) in (select ?, ?)"),
]


@pytest.mark.parametrize(("raw", "want"), PAIRS)
def test_normal_forms(raw, want):
    assert normalize(raw) == (want, False)


def test_broken_texts_fall_back():
    assert normalize("@@@ not  SQL ((") == ("@@@ not sql ((", True)
    assert normalize("select 'open") == ("select 'open", True)
    assert normalize(None) == normalize("  ") == ("", False)


@pytest.mark.parametrize(
    ("raw", "kind", "table"),
    [
        ("SELECT * FROM dbo.Users WHERE a = 1", "SELECT", "dbo.Users"), ("INSERT INTO Orders (a) VALUES (1)", "INSERT", "Orders"), ("UPDATE dbo.T SET a = 1", "UPDATE", "dbo.T"), ("DELETE FROM Logs", "DELETE", "Logs"),
        ("EXEC dbo.GetOrder @a = 1", "EXEC", "dbo.GetOrder"), ("garbage ((", "OTHER", None), ("SELECT * FROM a JOIN b ON a.x = b.x", "SELECT", None), ("SELECT * FROM (SELECT 1 AS x) d", "SELECT", None),
        ("SELECT 1 FROM a UNION SELECT 2 FROM b", "SELECT", None), ("MERGE t USING s ON 1 = 1 WHEN MATCHED THEN DELETE;", "OTHER", None), ("SELECT x FROM [my db].[dbo].[my table] AS m WHERE 1 = 1", "SELECT", "my db.dbo.my table"),
    ],
)
def test_classes(raw, kind, table):
    assert classify(raw) == (kind, table)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ_1'\"[]-/*@# \n.,()=é"), max_size=40))
def test_tokens_are_the_text(text):
    try:
        assert "".join(t.text for t in lex(text)) == text
    except ValueError:
        pass
    once, failed = normalize(text)
    assert isinstance(failed, bool) and once == once.strip()
