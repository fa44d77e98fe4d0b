import re

from tallybook.llm import credentials as c

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text, reach=200):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    borders = [m.start() for m in re.finditer(c.SCOPE, text)]
    scope = lambda p: sum(b < p[1] for b in borders)
    weak = [(k, m.start(), m.end()) for k, p in c.WEAK.items() for m in re.finditer(p, text, re.A)]
    weak = [p for p in weak if not any(p[1] < b[2] and b[1] < p[2] for b in base)]
    for p in weak:
        near = {c.ROLES[q[0]] for q in [*weak, *base] if q[1] <= p[2] + reach and q[2] >= p[1] - reach and scope(p) == scope(q)}
        role = c.ROLES[p[0]]
        wanted = {"identifier": {"secret"}, "secret": {"identifier"}, "endpoint": {"identifier", "secret"}}[role]
        if wanted <= near - {role}:
            base = [*base, (*p,)]
    return sorted(set(base), key=lambda p: (p[1], c.KINDS.index(p[0])))


STRONG_ID, HEX = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
TEXTS = [
    None, "", " ", f"id {STRONG_ID} and key aZ9{'k3' * 8} at https://api.example.com/v1 end", f"alone aZ9{'k3' * 8} here, https://x.example.com",
    f"username: bob7\n{'filler ' * 20}aZ9{'k3' * 8}", f"username: bob7\n{'filler ' * 60}aZ9{'k3' * 8}", f"user=bob7\n \nkey aZ9{'k3' * 8}",
    "token: token = 'abcdef123' PASSWORD=abc secret = \"x.y/z+1\" api-key=no apiKey=yes123", f"é👍 {HEX} password={HEX}", f"{HEX[:23]} AKIA123 AKIAAKIA{'Z' * 16}",
    f"client_id=web1 {HEX} 10.0.0.1:8080 then 999.1.2.3.4", "x" * 500 + f" login: joe1 {'s3' * 9} {STRONG_ID}" + " y" * 500,
    " ".join(f"user=u{i}x k{i:04d}{'q9' * 8} https://h{i}.example.org/p" for i in range(200)),
]


def test_against_brute_force(docs):
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])]
    table = docs(pairs).withColumnRenamed("lang", "spans").withColumnRenamed("source", "row")
    rows = c.find_credentials(table).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows)
    assert got == sorted((i if i is not None else -1, brute(t)) for i, t in pairs)
    kinds = {s.kind for r in rows for s in r.spans}
    assert kinds == set(c.KINDS)


def test_long_text_and_empty_table(docs, odd_texts):
    assert all(r.spans == [] for r in c.find_credentials(docs(odd_texts)).collect())
    assert c.find_credentials(docs([])).count() == 0


def test_weak_secrets_of_any_length(docs):
    """The first digit or letter of a mixed string may come late."""
    secret = "x" * 400 + "7" + "y" * 30
    got = c.find_credentials(docs([(1, f"login: someone {secret} end"), (2, f"nothing beside {secret} end")]))
    spans = {r.doc_id: [(s.kind, s.end - s.start) for s in r.spans] for r in got.collect()}
    assert ("mixed", 431) in spans[1] and spans[2] == []
