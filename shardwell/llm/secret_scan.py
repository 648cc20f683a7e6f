"""Secret scans: wide candidate patterns, then a random forest that removes false positives.

Candidates are values assigned to telling names (of several words too, where quotes or the end of the
line close them), strings with a known issuer's prefix, and long runs of letters and digits. The forest sees each candidate's length, character make-up and transitions,
how much of it dictionary words cover, whether it is part of a path, and the words beside it. It is
trained here, on labelled findings; `default_findings` makes such a set by rule from a seed (random
keys in the ways they are written, against hashes of files, commits, ids, paths, names, placeholders
and numbers), and any table of (text, start, end, label) can take its place.

Defined results: null or empty text has no findings; starts and lengths are in code points; repeated
rows give their findings each; a null doc_id is kept; overlapping candidates give one finding (a PEM
private key first, to its END line, then the assigned value, then the known prefix, then the longer run); an empty table gives an empty
result; other columns are not read by `scan` and carried untouched by `redact`, whose n_chars follows
the new text where there is such a column.
"""

from __future__ import annotations

import hashlib
import importlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, map_rows, query, text_of
from .textkit import flat, pieces

THRESHOLD = 0.5
TREES, DEPTH, LEAST_LEAF, SEED = 40, 9, 4, 7
#: Findings in the rule-made training set.
FINDINGS = 3000
MARK = "[secret]"
NEAR = 200

# Names under which secrets are assigned, and issuers' prefixes.
_NAMES = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|credential|bearer"
_NAMED = re.compile(rf"(?i)(?:{_NAMES})[a-z0-9_\-]*[\"'\]]?\s{{0,3}}:?$")
_SEPARATOR = re.compile(r"[=:]>?\s{0,3}")
_QUOTED = re.compile(r"[\"'`](?P<value>[^\s\"'`<>]{6,})")
# several words: within quotes, or after '=' to the end of the line
_QUOTED_PHRASE = re.compile(r"(?P<quote>[\"'`])(?P<value>[^\s\"'`<>]+(?: [^\s\"'`<>]+){1,15})(?P=quote)")
_PHRASE = re.compile(r"(?P<value>[A-Za-z0-9]{2,24}(?: [A-Za-z0-9]{2,24}){2,11})[ \t]*(?:\r?\n|$)")
# & ; , } ) end a bare value where the token ends or another assignment follows; elsewhere they are part of it
_BARE = re.compile(r"(?:(?i:bearer|basic)\s{1,3})?(?P<value>(?:[^\s\"'`<>&;,})]|[&;,})](?![&;,})]{0,8}(?:[\s\"'`<>]|$|[{(]?[\w.\-]{1,64}\s{0,3}[=:]))){6,})")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:(?:\s|\\[nrt])+[A-Za-z0-9+/=]{16,})*")
_ISSUED = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z+/=_.-]*[0-9])(?=[0-9+/=_.-]*[A-Za-z])[A-Za-z0-9+/=_.-]{20,}")
_WORD = re.compile(r"[^\W\d_]{3,}")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), ord("="), ord(":")]] = True
#: How an issued secret begins; other candidates hold a digit, '=' or ':'.
_ISSUED_BEGINS = r"AKIA|gh[pousr]_|sk-|xox[baprs]-|eyJ|-----BEGIN "
_TELLING = frozenset("token secret password passwd passphrase pwd key apikey api auth credential credentials bearer private access login".split())
_HARMLESS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision version etag file path build image integrity example sample placeholder test dummy phone order invoice number page isbn doi serial session request trace".split())
#: Words that hold sentences together; passphrases have few.
_BINDING = frozenset("the a an and or of to in is are was be for on with that this it you your not as by at from will can may must if".split())
_MODULES = "os logging argparse datetime collections subprocess shutil pathlib string configparser zipfile tarfile calendar statistics decimal ssl smtplib ftplib csv threading socket locale gettext platform getpass hashlib traceback inspect unittest http.client http.server urllib.parse urllib.request email.message html.parser xml.dom.minidom concurrent.futures".split()


@cache
def dictionary() -> frozenset[str]:
    """Words of identifiers and descriptions: public names that modules of the standard library define, names in their classes, and words that stand at least twice in the docstrings of both."""
    names, told = set(), Counter()
    for m in map(importlib.import_module, _MODULES):
        own = {k: v for k, v in vars(m).items() if not k.startswith("_") and callable(v) and getattr(v, "__module__", "") == m.__name__}
        for thing in [m, *own.values()]:
            told.update(w.lower() for w in re.findall(r"[A-Za-z]{3,}", str(getattr(thing, "__doc__", None) or "")))
        names |= own.keys() | {n for v in own.values() if isinstance(v, type) for n in vars(v)}
    split = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", n)}
    return frozenset(w for w in split | {w for w, n in told.items() if n > 1} if len(w) > 2)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates, in order, not overlapping."""
    found = [(a, b, "issued", -1) for a, b in private_keys(text)]
    assigned: list[tuple[int, int, str, int]] = []
    reach = 0  # where the last bare value ends; all that begin in it end there
    for m in _SEPARATOR.finditer(text):
        low = max(0, m.start() - 64)
        named = _NAMED.search(text[low : m.start()])
        if not named:
            continue
        if m.end() < reach:
            start, end = m.end(), reach
        elif value := _QUOTED_PHRASE.match(text, m.end()) or _QUOTED.match(text, m.end()) or ("=" in m[0] and _PHRASE.match(text, m.end())):
            start, end = value.span("value")
        elif value := _BARE.match(text, m.end()):
            start, end = value.span("value")
            reach = end
        else:
            continue
        if end - start < 6:
            continue
        if assigned and assigned[-1][1] > start:  # an assignment within a value ends it
            s, e, *_ = assigned.pop()
            e = min(e, low + named.start())
            if e - s >= 6:
                assigned.append((s, e, "assigned", 0))
        assigned.append((start, end, "assigned", 0))
    found += assigned
    found += [(m.start(), m.end(), "issued", 1) for m in _ISSUED.finditer(text)]
    found += [(m.start(), m.end(), "run", 2) for m in _RUN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for rank in (-1, 0, 1, 2):
        new, k = [], 0
        for s, e, kind, r in sorted(x for x in found if x[3] == rank):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if (k < len(taken) and taken[k][0] < e) or (new and new[-1][1] > s):
                continue
            new.append((s, e))
            out.append((s, e, kind))
        taken = sorted(taken + new)
    return sorted(out)


def private_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of PEM private keys, to the end of their END lines; without one, of the BEGIN line and the base64 that follows."""
    begins = list(_PEM.finditer(text))
    ends = [m.end() for m in _PEM_END.finditer(text)] if begins else []
    out = []
    for n, m in enumerate(begins):
        limit = begins[n + 1].start() if n + 1 < len(begins) else len(text)
        k = bisect_right(ends, m.end())
        out.append((m.start(), ends[k] if k < len(ends) and ends[k] <= limit else _PEM_BODY.match(text, m.end()).end()))
    return out


def _coverage(value: str, words: frozenset[str], around: set[str]) -> float:
    """Share of the value's characters under words of the dictionary or of the text around it."""
    low, n = value.lower(), len(value)
    covered, at = 0, 0
    while at < n:
        best = 0
        for size in range(min(14, n - at), 2, -1):
            if (part := low[at : at + size]) in words or part in around:
                best = size
                break
        covered += best
        at += best or 1
    return covered / max(n, 1)


def features(text: str, start: int, end: int, words: frozenset[str] | None = None) -> list[float]:
    words = dictionary() if words is None else words
    value, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 48]
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    count, kind = Counter(value), Counter(kinds)
    m = n
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    entropy = -sum(c / m * math.log2(c / m) for c in count.values())
    around = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    beside = {w.lower() for w in re.findall(r"[A-Za-z0-9]+", before[-40:])[-4:]}
    split = {p for w in re.findall(r"[A-Za-z0-9_\-]+", before[-40:])[-3:] for p in re.split(r"[_\-]|(?<=[a-z])(?=[A-Z])", w)}
    beside |= {p.lower() for p in split}
    beside |= {p.rstrip(string.digits) for p in beside}  # token2
    nearest = (re.findall(r"[A-Za-z0-9]+", before) or [""])[-1].lower()
    nearest = nearest.rstrip(string.digits) or nearest
    return [
        min(n, 2000), math.log(n), turns / m, entropy, entropy / math.log2(m + 1), len(count) / m,
        kind["d"] / m, kind["u"] / m, kind["l"] / m, kind["s"] / m,
        sum(c in "0123456789abcdef" for c in value) / m, float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None), float(m in (32, 40, 64)),
        _coverage(value, words, around), max((len(w) for w in re.findall(r"[A-Za-z]+", value)), default=0) / m,
        value.count("/") + value.count("\\"), float(bool(re.search(r"\.[a-z]{1,5}$", value))), value.count("."), value.count("-"), value.count("_"),
        float("://" in before[-12:] + value or before[-1:] in ("/", "\\") or after[:1] in ("/", "\\")), float(before[-1:] == "@" or "@" in value),
        float(bool(beside & _TELLING)), float(bool(beside & _HARMLESS)), float(nearest in _TELLING), float(nearest in _HARMLESS),
        float(bool(re.search(r"[=:]>?\s{0,3}[\"'`]?$", before))), float(before[-1:] in ("'", '"', "`") and before[-1:] == after[:1]),
        float(bool(_ISSUED.match(value))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))), max(count.values(), default=0) / m,
        value.count(" "), sum(w in _BINDING for w in value.lower().split()) / max(1, value.count(" ") + 1), float(not after or after[:1] in "\r\n"),
    ]


class Forest:
    """Random forest as flat arrays; leaves hold the share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.trees, self.words = trees, dictionary()

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        tried = max(2, int(math.sqrt(x.shape[1])) + 1)
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            feature, cut, child, share = [], [], [], []
            todo = [(rows, 0, None)]
            while todo:
                own, level, parent = todo.pop()
                k = len(feature)
                if parent is not None:
                    child[parent[0]][parent[1]] = k
                feature.append(-1)
                cut.append(0.0)
                child.append([k, k])
                share.append(float(y[own].mean()))
                if level >= depth or len(own) < 2 * LEAST_LEAF or share[k] in (0.0, 1.0):
                    continue
                best = (1e-9, None, None)
                whole = share[k] * (1 - share[k])
                for f in rng.choice(x.shape[1], tried, replace=False):
                    order = np.argsort(x[own, f], kind="stable")
                    v, t = x[own, f][order], y[own][order]
                    ones, left = np.cumsum(t), np.arange(1, len(own) + 1)
                    ok = np.flatnonzero(v[1:] > v[:-1])
                    ok = ok[(ok + 1 >= LEAST_LEAF) & (len(own) - ok - 1 >= LEAST_LEAF)]
                    if not len(ok):
                        continue
                    a, n = ones[ok] / left[ok], len(own)
                    b = (ones[-1] - ones[ok]) / (n - left[ok])
                    gain = whole - (left[ok] * a * (1 - a) + (n - left[ok]) * b * (1 - b)) / n
                    g = int(gain.argmax())
                    if gain[g] > best[0]:
                        best = (gain[g], f, (v[ok[g]] + v[ok[g] + 1]) / 2)
                if best[1] is None:
                    continue
                feature[k], cut[k] = int(best[1]), float(best[2])
                low = x[own, best[1]] <= best[2]
                todo += [(own[low], level + 1, (k, 0)), (own[~low], level + 1, (k, 1))]
            out.append((np.array(feature), np.array(cut), np.array(child), np.array(share)))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                at = np.where(f < 0, at, child[at, (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]).astype(int)])
            total += share[at]
        return total / len(self.trees)


def default_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, 1 for a secret), made by rule."""
    rng = random.Random(seed)
    pick = rng.choice
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    alnum = lambda k: "".join(rng.choices(string.ascii_letters + string.digits, k=k))
    syllables = "ba co de ti on er an re is ing the lo ma ne pro ver te ra sen st un ion al ent ch ou qui el los der ein".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    known = sorted(dictionary())
    binding = sorted(_BINDING)
    prose = lambda k: " ".join(pick([word(), word(), word().capitalize(), word() + pick(",.;"), pick(known)]) for _ in range(k))
    secret_names = ["token", "api_key", "apiKey", "secret", "password", "access_key", "auth_token", "private_key", "TOKEN", "SECRET_KEY", "client_secret", "passwd", "credential"]
    other_names = ["commit", "sha256", "md5", "checksum", "etag", "revision", "uuid", "request_id", "trace", "build", "integrity", "file", "version", "session id", "image"]
    identifier = lambda: pick(["", "get", "my", "the"]) + "".join(pick(known).capitalize() for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 99))

    def secret() -> tuple[str, str, str]:
        value = pick([lambda: hexes(pick([32, 40, 64, 48])), lambda: alnum(rng.randint(16, 64)), lambda: alnum(rng.randint(27, 60)) + "=", lambda: alnum(rng.randint(8, 14)) + pick("!#$%"), lambda: hexes(pick([32, 40, 64]))])()
        issued = pick(["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), "ghp_" + alnum(36), "sk-" + alnum(40), "xoxb-" + alnum(24), "eyJ" + alnum(20) + "." + alnum(30) + "." + alnum(30)])
        name, sep, q = pick(secret_names), pick([" = ", "=", ": ", ":", " => "]), pick(['"', "'", "", "`"])
        if rng.random() < 0.12:
            return f"{pick(['the secret is', 'my api key', 'use token', 'the password is', 'private key', 'login with the token', 'credential', 'access key'])} ", pick([alnum(rng.randint(24, 64)) + str(rng.randint(0, 9)), hexes(pick([40, 64]))]), pick(["", ".", ","])
        if rng.random() < 0.12:
            q = pick(['"', "'", ""])
            value = " ".join(pick([pick(known), word()]) for _ in range(rng.randint(3 if not q else 2, 6)))
            return f"{pick(['password', 'passphrase', 'PASSWORD', 'passwd', 'secret', 'wifi_password'])}{pick([' = ', '=']) if not q else sep}{q}", value, q or "\n"
        return pick([(f"{name}{sep}{q}", value, q), (f"{name}{sep}{q}", value, q), (f"{name}{sep}{q}", value, q), (f"{pick(['', 'key ', 'use '])}{q}", issued, q), ("Authorization: Bearer ", alnum(rng.randint(24, 60)), "")])

    def harmless() -> tuple[str, str, str]:
        name, sep, q = pick(other_names), pick([" = ", "=", ": ", " "]), pick(['"', "", ""])
        uuid = "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
        said = lambda: " ".join(pick([pick(binding), pick(known), word()]) for _ in range(rng.randint(3, 9)))
        return pick([
            lambda: (f"{pick(secret_names)}{pick([' = ', ': '])}\"", said() + pick(["", ".", "?"]), '"'), lambda: (f"{pick(secret_names)} = ", pick(binding) + " " + said(), "\n"),
            lambda: (f"{name}{sep}{q}", hexes(pick([32, 40, 64])), q), lambda: (f"{name}{sep}{q}", hexes(pick([32, 40, 64])), q), lambda: ("", uuid, ""), lambda: (f"{name}{sep}", uuid, ""),
            lambda: (pick(["", "see ", "/"]), "/".join(word() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)) + pick([".py", ".txt", "", ".html", "/"]), ""),
            lambda: (pick(["", "https://"]), f"{word()}.{word()}.com/{word()}/{word()}-{word()}-{rng.randint(1, 9999)}", ""),
            lambda: ("", identifier(), pick(["", "()", ";"])), lambda: ("", "_".join(pick(known) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 9)), ""),
            lambda: (f"{pick(secret_names)}{pick([' = ', ': ', '='])}{q}", pick(["changeme", "your_" + pick(secret_names).lower() + "_here", "x" * rng.randint(8, 40), "*" * rng.randint(6, 20), "example", "placeholder", "<redacted>", "password", "os.environ", "config.get(key)", "${SECRET}", "process.env.TOKEN", identifier(), word() + word(), word() + "," , word() + "." + word(), prose(1) + pick(",.") ]), q),
            lambda: ("", "-".join(word() for _ in range(rng.randint(4, 7))) + "-" + str(rng.randint(1, 2030)), ""),
            lambda: (pick(["", "order ", "phone "]), str(rng.randint(10**8, 10**9)) + pick(["a", "x1", "-b"]) + str(rng.randint(10**10, 10**11)), ""), lambda: ("", (word() + word()) * 2 + str(rng.randint(1, 9)) + word() * 2, ""),
            lambda: ("", f"user{rng.randint(1, 99)}.{word()}{rng.randint(1, 99)}.{word()}.example.com", ""),
        ])()

    out = []
    for i in range(n):
        label = i % 2
        before, value, after = (secret if label else harmless)()
        left, right = prose(rng.randint(0, 25)), prose(rng.randint(0, 25))
        text = f"{left}{pick([' ', chr(10)])}{before}{value}{after}{pick([' ', chr(10), ', ', '.', '; ', ')'])}{right}"
        start = len(left) + 1 + len(before)
        out.append((text, start, start + len(value), label))
    return out


def train(findings: Iterable[tuple[str, int, int, int]] | None = None) -> Forest:
    rows = list(default_findings() if findings is None else findings)
    return Forest.fit(np.array([features(t, s, e) for t, s, e, _ in rows]), np.array([y for *_, y in rows], np.float64))


def holds_any(column: pa.Array) -> np.ndarray:
    """Texts in which a pattern can match at all."""
    data, at = flat(column)
    run = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
    issued = np.asarray(pc.fill_null(pc.match_substring_regex(column, _ISSUED_BEGINS), False))
    return (run[at[1:]] > run[at[:-1]]) | issued


def findings_of(batch: pa.RecordBatch, forest: Forest, column: str = "text") -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) for each text of a batch."""
    texts = pc.fill_null(batch.column(column), "").to_pylist()
    out: list[list] = [[] for _ in texts]
    rows, at = [], []
    for i in np.flatnonzero(holds_any(batch.column(column))).tolist():
        for s, e, kind in candidates(texts[i]):
            rows.append(features(texts[i], s, e, forest.words))
            at.append((i, s, e, kind))
    if rows:
        for (i, s, e, kind), score in zip(at, forest.score(np.array(rows)).tolist(), strict=True):
            out[i].append((s, e, kind, score))
    return out


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each candidate: doc_id, start, length, kind, value_sha256, score, secret. The value itself is not given out."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train())

    def go(batches):
        for whole in batches:
            for batch in pieces(whole):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = [(ids[i], s, e - s, kind, hashlib.sha256(texts[i][s:e].encode()).hexdigest(), score, score >= threshold) for i, found in enumerate(findings_of(batch, sent.value)) for s, e, kind, score in found]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "kind", "value_sha256", "score", "secret"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return base.mapInArrow(go, "doc_id long, start long, length long, kind string, value_sha256 string, score double, secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with each secret replaced by MARK; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train())
    names = docs.columns

    def go(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                for i, found in enumerate(findings_of(batch, sent.value, text_col)):
                    for s, e, _, score in reversed(found):
                        if score >= threshold:
                            texts[i] = texts[i][:s] + MARK + texts[i][e:]
                columns = dict(zip(names, batch.columns, strict=True)) | {text_col: pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                    columns["n_chars"] = pc.if_else(pc.fill_null(pc.equal(batch.column(text_col), columns[text_col]), True), columns["n_chars"], sizes.cast(columns["n_chars"].type))
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return map_rows(docs, go)


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))
