import hashlib
import random
import re

from loomwork.llm.secret_scan import _characters, find_secrets, redact_secrets, scan_secrets
from tests.llm.fixtures import documents, hard_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex")


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_regexes():
    random.seed(1)
    bits = ["token", "secret", "api_key", "apikey", "PassWord", "=", ":", " ", '"', "'", "abc", "x=", "AKIA", "ABCDEFGH01234567",
            "0123456789ab", "deadbeef", "/", ".", "-", "\n", ",", "é", "ghp_", "eyJ"]
    for _ in range(3000):
        s = "".join(random.choice(bits) for _ in range(random.randint(1, 25)))
        assert _characters(s.encode(), [x for x in find_secrets(s.encode()) if x[1] < 3]) == plain(s), s


def test_scan_of_rows(spark):
    texts = hard_texts() + [(20, "é token = abcdef12 é AKIA" + "A1" * 9), (21, "f" * 9000), (22, "ghp_" + "a1B2" * 10 + " xoxb-" + "1" * 12)]
    got = sorted(scan_secrets(documents(spark, texts)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert len(got) == len(texts)
    text = dict(texts)
    for r in got:
        spans = plain(text[r["doc_id"]])
        told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))
    assert "github:0:44" in got[-1]["spans"] and "slack" in got[-1]["spans"]
    assert scan_secrets(documents(spark, texts).limit(0)).count() == 0


def test_redaction(spark):
    docs = documents(spark, hard_texts() + [(20, "é token = abcdef12 and deadbeef" * 1)])
    got = {r["doc_id"]: r for r in redact_secrets(docs).collect()}
    assert redact_secrets(docs).schema == docs.schema
    assert got[20]["text"] == "é [SECRET] and deadbeef" and got[20]["n_chars"] == len(got[20]["text"])
    assert all(got[k]["text"] == t for k, t in hard_texts())


def test_private_keys_with_their_bodies(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA" + chr(97 + k % 26) * 40 for k in range(30))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN PRIVATE KEY-----\n{body}"
    texts = [(1, f"before {key} after"), (2, f"é {key}{key}."), (3, cut + " -- and more"), (4, "-----BEGIN CERTIFICATE-----")]
    got = {r["doc_id"]: r["text"] for r in redact_secrets(documents(spark, texts)).collect()}
    assert got[1] == "before [SECRET] after" and got[2] == "é [SECRET][SECRET]." and got[4] == texts[3][1]
    assert got[3].startswith("[SECRET]") and got[3].endswith("-- and more") and "MIIE" not in got[3]
    told = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(spark, texts)).collect()}
    assert told[1].split(",")[0] == f"private_key:7:{7 + len(key)}"


def test_formats_of_issuers():
    from loomwork.llm.secret_scan import RULES

    made = {
        "github": "ghp_" + "a1B2" * 9, "github_pat": "github_pat_" + "a1B2_" * 10, "gitlab": "glpat-" + "x1Y-" * 5, "slack": "xoxb-123456-abcdefg",
        "slack_hook": "https://hooks.slack.com/services/T00000000/B00000000/" + "X" * 24, "google": "AIza" + "Ab1-_" * 7, "google_oauth": "ya29." + "a" * 30,
        "stripe": "sk_live_" + "a1B2" * 6, "npm": "npm_" + "aB1c" * 9, "pypi": "pypi-" + "AgEI" * 20, "sendgrid": "SG." + "a" * 22 + "." + "b" * 43,
        "twilio": "AC" + "0f" * 16, "digitalocean": "dop_v1_" + "0a" * 32, "huggingface": "hf_" + "aB" * 17, "shopify": "shpat_" + "0a" * 16,
        "bearer": "Authorization: Bearer " + "aB1." * 8, "url_password": "postgres://user:pa55!word@host/db", "jwt": "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4fwpMeJf36POk6y",
    }
    for kind, text in made.items():
        found = [(RULES[r].kind, s, e) for s, r, e in find_secrets(f"see {text} here".encode())]
        assert any(k == kind for k, _, _ in found), kind
        assert not any(RULES[r].kind == kind for _, r, _ in find_secrets(f"see {text[: len(text) // 2]} here".encode())) or kind in ("slack", "url_password"), kind
