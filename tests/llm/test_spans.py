"""The spans that the methods of op7 and op10 add, against searches place by place."""

import random
import re

import numpy as np
import pyarrow as pa

from foliograph.llm import personal_data, secret_scan, textblocks

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte")
USER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~%!$&'()*+,;=:-"
HOST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-"


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def brute_urls(text):
    """A scheme, user information, an at-sign, a host, and a port and path if there are any."""
    out = []
    for at in range(len(text)):
        for scheme in SCHEMES:
            if not text.startswith(scheme, at):
                continue
            user = run_of(text, at + len(scheme), USER)
            if user == at + len(scheme) or text[user : user + 1] != "@":
                continue
            end = run_of(text, user + 1, HOST)
            if end == user + 1:
                continue
            while text[end : end + 1] == "." and run_of(text, end + 1, HOST) > end + 1:
                end = run_of(text, end + 1, HOST)
            if text[end : end + 1] == ":" and run_of(text, end + 1, "0123456789") > end + 1:
                end = run_of(text, end + 1, "0123456789")
            if text[end : end + 1] == "/":
                while end < len(text) and not text[end].isspace() and text[end] not in '<>"':
                    end += 1
            out.append(("url", at, end))
    return out


def checks(value):
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in compact[4:] + compact[:4])) % 97 == 1


def brute_accounts(text):
    """Behind a cue: the longest checked IBAN, or 8 to 17 digits."""
    out = set()
    for at in range(len(text)):
        for cue in CUES:
            if text[at : at + len(cue)] not in (cue, cue.upper(), cue.capitalize()):
                continue
            place = at + len(cue)
            place += len(re.match(r"(?:\x20?(?:no|nr|number|num)\b\.?)?\x20{0,2}[:#=]?\x20{0,2}", text[place:], re.I).group())
            rest = text[place:]
            whole = re.match(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", rest)
            good = [n for n in range(15, (whole.end() if whole else 0) + 1) if rest[n - 1] != " " and checks(rest[:n])]
            if good:
                out.add(("iban", place, place + max(good)))
            elif m := re.match(r"[0-9](?:[\x20-]?[0-9]){7,16}(?![0-9])", rest):
                out.add(("account", place, place + m.end()))
    return sorted(out)


def test_added_personal_data():
    rng = random.Random(12)
    parts = [
        "http://", "https://", "ftp://", "joe:pw@", "ex.org", "ex", "@", ":", ":80", "/a/b?c", " ", "  ", "\n", "<", '"', "é", "iban", "IBAN ", "Konto", "account no. ", "acct#", "kontonummer: ", "GB29NWBK60161331926819",
        "GB29 NWBK 6016 1331 9268 19", "GB28 NWBK 6016 1331 9268 19", "AB", "12345678", "1234-5678 9012", "99", "x",
    ]
    added = 0
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        got = [s for s in personal_data.find_spans(text) if s[0] not in personal_data.BASE_KINDS]
        want = sorted(brute_urls(text) + brute_accounts(text), key=lambda s: (s[1], personal_data.KINDS.index(s[0]), s[2]))
        assert got == want, text
        added += len(got)
    assert added > 1000


def test_added_secrets():
    rng = random.Random(13)
    table = secret_scan.train(["9f8e7d6c5b4a39281706", "q8Zk3"], ["ordinaryidentifier", "some_long_function_name", "AnotherClassName"] * 20)
    letters = secret_scan.ALPHABET
    parts = ["token=", " ", "é", "\n", "ordinary_words_in_a_row_of_letters", "AnotherClassNameForAll", ".", "abc"]
    texts = []
    for _ in range(1500):
        made = ["".join(rng.choices(letters, k=rng.randint(8, 40))) for _ in range(2)]
        texts.append("".join(rng.choices(parts + made, k=rng.randint(0, 8))))
    found = 0
    for block in textblocks.blocks(pa.array(texts), 5000):
        part = texts[block.row : block.row + block.n]
        for text, spans in zip(part, secret_scan.scan(block, pa.array(part), table, 12.0, 0.6), strict=True):
            base = [s for s in spans if s[0] != "random"]
            want = []
            for m in re.finditer("[" + re.escape(letters) + "]{16,}", text):
                codes = [letters.index(c) for c in m.group()]
                llr = sum(table[a, b] for a, b in zip(codes, codes[1:], strict=False))
                far = min(abs(llr - 12.0), abs(llr - 0.6 * (len(codes) - 1)))
                if far > 1e-6 and llr >= 12.0 and llr >= 0.6 * (len(codes) - 1) and not any(a < m.end() and m.start() < b for _, a, b in base):
                    want.append(("random", m.start(), m.end()))
            assert [s for s in spans if s[0] == "random"] == want
            found += len(want)
    assert found > 50


def test_models_are_ratios_of_transition_counts():
    table = secret_scan.train(["ab" * 20], ["aa"], drawn=0)
    a, b = (secret_scan.ALPHABET.index(c) for c in "ab")
    n = len(secret_scan.ALPHABET)
    random_ab, ordinary_ab = (20 + 1) / (20 + n), 0.5 / (2 + 0.5 * n)  # the ordinary form counts as it is and in lower case
    assert np.isclose(table[a, b], np.log(random_ab) - np.log(ordinary_ab))
