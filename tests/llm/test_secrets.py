"""Secrets: patterns and novelty against plain versions, planted strings, harmless ones."""

from __future__ import annotations

import random
import re
import string
from collections import Counter

import pytest
import zstandard
from llm_support import documents, odd_rows, prose

from shelfmark.llm.secrets import Novelty, base_spans, find_secrets

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def plain_assign(text):
    """The pattern by hand: at each place the longest name that fits, then the parts in order."""
    found, i = [], 0
    while i < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if "".join(c.lower() if c in string.ascii_letters else c for c in text[i : i + len(name)]) == name:
                j = i + len(name)
                for quoted in (1, 0):
                    k = j + 1 if quoted and text[j : j + 1] in ("'", '"') and j < len(text) else j
                    while text[k : k + 1] == " ":
                        k += 1
                    if text[k : k + 1] in (":", "=") and k < len(text):
                        k += 1
                        while text[k : k + 1] == " ":
                            k += 1
                        if k < len(text) and text[k] in "'\"":
                            k += 1
                        start = k
                        while k < len(text) and text[k] in VALUE:
                            k += 1
                        if k > start:
                            end = (k, k - start)
                            break
        if end is None:
            i += 1
            continue
        if end[1] >= 8:
            found.append((i, end[0]))
        i = end[0]
    return found


def plain_runs(text, alphabet, least, begins=""):
    found, i = [], 0
    while i < len(text):
        if text[i : i + len(begins)] == begins and text[i] in alphabet:
            j = i + len(begins)
            while j < len(text) and text[j] in alphabet:
                j += 1
            if j - i >= least and (not begins or j > i + len(begins)):
                found.append((i, j))
            i = max(j, i + 1)
        else:
            i += 1
    return found


PIECES = ["token", "SECRET", "Api_Key", "apikey", "passwd", "password", '"', "'", " ", "  ", ":", "=", "==", "abcdefgh", "x9", "AKIA", "ABCDEFGHIJKL", "0f" * 9, "0f" * 17, "\n", "é", "ſecret", "toKen"]


@pytest.mark.parametrize("seed", range(300))
def test_base_spans(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
    got = base_spans(text)
    assert got["assign"] == plain_assign(text)
    assert got["access"] == plain_runs(text, set(string.ascii_uppercase + string.digits), 16, "AKIA")
    assert got["hex"] == plain_runs(text, set("0123456789abcdef"), 32)


def key(seed, n, alphabet=string.ascii_letters + string.digits):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def config(seed, value):
    rng = random.Random(seed)
    name = rng.choice(["handler", "service", "worker", "gateway"])
    return f"{prose(seed, 30)}\ndef connect_{name}(host, user):\n    # the credential of this {name}\n    return open(host, user, {value})\n{prose(seed + 1, 30)}"


def plain(rows):
    """Dictionary and novelty from their definitions."""
    sensitive = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|authorization|api[_-]?key|(?:access|private|signing|encryption|client|master|session)[_-]?(?:key|id)", re.I | re.A)
    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        base = base_spans(text)
        spans = [(s, k, e) for k, kind in enumerate(("assign", "access", "hex")) for s, e in base[kind]]
        runs = []
        for m in re.finditer(r"[A-Za-z0-9+/_.-]{16,}={0,2}", text):
            whole = m.group(0)
            start = m.start() + len(whole) - len(whole.lstrip(".-_/"))
            end = m.end() - (len(whole) - len(whole.rstrip(".-_/")))
            near = any(w.start() < end and w.end() >= start - 64 for w in sensitive.finditer(text))
            free = all(e <= start or s >= end for s, _, e in spans)
            run = text[start:end]
            kinds = bool(re.search("[a-z]", run)) + bool(re.search("[A-Z]", run[1:])) + bool(re.search("[0-9]", run))
            if end - start >= 16 and near and free and kinds > 1:
                runs.append((start, end))
        near = set()
        for s, e in runs:
            near.update(range(max(0, s - 256), min(len(text), e + 256)))
        around = "".join(c if i in near else "\0" for i, c in enumerate(text))
        counts.update(set(re.findall("[A-Za-z]{3,}", around)))
        found.append((doc_id, text, spans, runs))
    words = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:4096]
    while sum(len(w) + 1 for w in words) > 32 * 2**10:
        words.pop()
    data = " ".join(reversed(words)).encode()
    parameters = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, write_content_size=False, write_dict_id=False, write_checksum=False)
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
    compressor = zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)
    out = []
    for doc_id, text, spans, runs in found:
        for s, e in runs:
            before, run, after = text[max(0, s - 256) : s], text[s:e], text[e : e + 256]
            sizes = [len(compressor.compress(t.encode())) for t in (before + after, before + run + after, f"{run} {before}{after}", f"{before}{after} {run}")]
            if min(sizes[1:]) - sizes[0] >= 2 + 0.75 * (e - s):
                spans.append((s, 3, e))
        out.append((doc_id, sorted(spans)))
    return out


def test_against_plain_version(spark):
    rows = [(i, config(i, f'"{key(i, 14 + i % 30)}"')) for i in range(60)]
    rows += [(100 + i, config(i, f"settings_of_{i}_handler2")) for i in range(20)]
    rows += [(200 + i, prose(i, 100) + f' token = "{key(i, 40, "0123456789abcdef")}" ' + prose(i + 7, 50)) for i in range(10)]
    rows += [(300, "bearer " + key(1, 200_000) + " end"), (301, "token" * 5000 + " x"), (302, "password" + " " * 5000 + "x")]
    rows += [(303, f"secret {key(8, 20)} {key(9, 20)}\n" * 40), (304, "\U0001f600 é credential " + key(11, 24))]
    rows += odd_rows()
    got = find_secrets(documents(spark, rows)).collect()
    kinds = ("assign", "access", "hex", "novel")
    mine = sorted(((r.doc_id, [(s.start, kinds.index(s.kind), s.end) for s in r.spans]) for r in got), key=repr)
    assert mine == sorted(plain(rows), key=repr)
    assert all([s for s in r.spans if s.kind != "novel"] == r.base for r in got)


def test_planted_and_harmless(spark):
    names = ["retry_handler_v2", "connect_to_service1", "handler.service.open2", "worker_gateway_host1"]
    rows = [(i, config(i, key(i, 20 + i % 20))) for i in range(100)]
    rows += [(1000 + i, config(i, names[i % 4])) for i in range(100)]
    rows += [(2000 + i, prose(i, 60) + " " + key(i, 32)) for i in range(50)]  # no sensitive word near
    got = {r.doc_id: [s for s in r.spans if s.kind == "novel"] for r in find_secrets(documents(spark, rows, clashing=False)).collect()}
    assert sum(bool(got[i]) for i in range(100)) >= 90
    assert sum(bool(got[i]) for i in range(1000, 1100)) <= 5
    assert not any(got[i] for i in range(2000, 2050))


def test_dictionary_lowers_novelty():
    text = "credential: " + "quarterly_report_archive9" + " of the service"
    at = len("credential: ")
    plain, primed = Novelty(b""), Novelty(b"archive report quarterly " * 3)
    end = at + len("quarterly_report_archive9")
    assert primed.bytes_of(text, at, end) < plain.bytes_of(text, at, end)


def test_empty_table(spark):
    assert find_secrets(documents(spark, [])).collect() == []
