"""Secret scan: base patterns against plain loops, the lexer on sources and configurations, awkward rows."""

import hashlib
import re
import sys
import time
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward, awkward_rows, empty  # noqa: E402

from marshlight.llm import queries, secrets  # noqa: E402

ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)


def base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", "=", ":", " ", "'", '"', "\n", "abc123", "AKIA", "ABCDEF0123456789XY", "deadbeef" * 3, "0f", "é", "=="]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets._listed(secrets.base_spans(text)) == base(text)


def found(text):
    return [text[a:b] for a, b in secrets.literals(text)]


def test_assignments():
    assert found('db_password = "hunter2hunter"') == ["hunter2hunter"]
    assert found("cfg.authToken: 'q8Zr1Lx0Pm'") == ["q8Zr1Lx0Pm"]
    assert found("env['PRIVATE_KEY'] = \"abc987def654\"") == ["abc987def654"]
    assert found('k = "s3cr3tV4lue99"\nclient(1)\npasswd = k\n') == ["s3cr3tV4lue99"]
    assert found('a = "part1-92"\nb = "x71q" + a\naccess_token := b') == ["part1-92", "x71q"]
    assert found('"clientSecret" => "zz81kq0plm2"') == ["zz81kq0plm2"]


def test_typed_declarations():
    for text in (
        'api_secret: str = "{}"', 'api_secret: Optional[str]="{}"', 'def f(api_secret: str | None = "{}", n: int = 3)', 'api_secret: "str" = "{}"',
        "const token: string = '{}';", "private token?: Array<string> = '{}'", "let token: Map<string, () => void> = '{}'",
        'let password: &str = "{}";', 'const API_KEY: &\'static str = "{}";', 'let mut password: std::borrow::Cow<\'_, str> = "{}";',
        'var dbPassword string = "{}"', 'const apiKey string = "{}"', '\tdbPassword string = "{}"', 'var dbPassword config.Value = "{}"', "var dbPassword []byte = '{}'",
        "DECLARE @password NVARCHAR(50) = '{}'", 'Password : constant String := "{}";', 'val password: String = "{}"',
        'String password = "{}"', 'const char *password = "{}"', 'const std::string password = "{}"', 'let password = "{}"', 'var password = "{}"', "private string $password = '{}'",
    ):
        assert found(text.format("q8Zr1Lx0Pm")) == ["q8Zr1Lx0Pm"], text


def test_joined_constants_stay_small():
    """A name doubled on each line stands for 2^n characters; none of them is built, and long chains cost what they are long."""
    for lines in (64, 3000):
        text = "a0 = 'k9Zr1Lx0Pm'\n" + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, lines)) + f"password = a{lines - 1}\n"
        began = time.process_time()
        assert found(text) == ["k9Zr1Lx0Pm"]
        assert time.process_time() - began < 1
    text = "a0 = 'k9'\n" + "".join(f"a{i} = a{i - 1} + 'x{i}'\n" for i in range(1, 2000)) + "".join(f"token = a{i}\n" for i in range(1000, 2000))
    began = time.process_time()
    assert len(found(text)) == 2000
    assert time.process_time() - began < 4


def test_long_declarations():
    fields = ", ".join(f"f{i} int" for i in range(200))
    assert found("var dbPassword func(" + fields + ") string = 'q8Zr1Lx0Pm'") == found("var dbPassword func(f int) string = 'q8Zr1Lx0Pm'")
    assert found("DECLARE @password NVARCHAR(" + " " * 400 + "50) = 'q8Zr1Lx0Pm'") == ["q8Zr1Lx0Pm"]
    began = time.process_time()
    found("a b(" * 50_000 + "=" + "a b(" * 50_000 + "= x")
    found("a = b; " * 30_000)
    assert time.process_time() - began < 3


def test_types_are_no_constants():
    assert found('title: str = "a8Zr1Lx0Pm"\npassword: str = other\n') == []
    assert found('title: str = "a8Zr1Lx0Pm"\npassword: str = "q8Zr1Lx0Pm"\n') == ["q8Zr1Lx0Pm"]
    assert found('var title string = "a8Zr1Lx0Pm"\nvar password = string\n') == []
    assert found('k: Final[str] = "s3cr3tV4lue99"\npasswd: str = k\n') == ["s3cr3tV4lue99"]
    assert found('var k string = "s3cr3tV4lue99"\npasswd = k\n') == ["s3cr3tV4lue99"]
    assert found("password: q8Zr1Lx0Pm=\ntoken: q9Zr1Lx0Pm=x\n") == ["q8Zr1Lx0Pm=", "q9Zr1Lx0Pm=x"]


def test_typed_marks_take_linear_time():
    for text in ("a:[" * 60000, "a: b<" * 40000, "var a = " * 30000, "a:" + "b|" * 60000, "a: &" * 50000):
        secrets.literals(text)


def test_what_is_no_secret():
    assert found('password = "changeme123"') == []
    assert found('token == "q8Zr1Lx0Pm"') == []
    assert found("password: ${DB_PASSWORD}") == []
    assert found("see https://host/token:x and std::token") == []
    assert found("note: the token was here") == []
    assert found('title = "a8Zr1Lx0Pm"') == []


def test_placeholders_are_words_not_parts_of_values():
    for value in ("sk_test_4eC39HqLyjWDarjtT1zdp7dc", "Contest2024xQ", "nullable77Zx", "q8Zr1Lx0Pmtodo", "AbtrueZr81Lx", "example-q8Zr1Lx0Pm"):
        assert found(f'password = "{value}"') == [value], value
    for value in ("test1234", "changeme123", "ChangeMe123", "your_token_here", "auth-your-key", "xxxxxxxxxxxx", "none-null", "TestTest", "placeholder", "true_or_false"):
        assert found(f'auth_token = "{value}"') == [], value


def test_awkward_and_empty(spark):
    rows = secrets.scan_secrets(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        assert r["base_spans"] == base(r["text"] or "") and r["rid"] == "x"
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_query(spark, con):
    want = {i: base(t or "") for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    rows = queries.QUERIES["op9_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want)
    for r in rows:
        spans = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(spans.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
