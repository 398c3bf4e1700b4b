"""Personal data: labelers vote on spans, expectation-maximisation weighs them and trains the span classifier."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import bound_batches, materialize

#: Kinds in the order of output; the first four have base rules, spans of the others are found by the method alone.
KINDS = ("email", "ip", "card", "phone", "secret", "local_phone", "iban", "national_id", "person")
BASE = KINDS[:4]
#: Labelers, in the order of their votes. The first, third and fourth propose spans, too.
LABELERS = ("pattern", "check", "gazetteer", "context", "shape")
#: Least probability of an added span.
THRESHOLD = 0.8
#: Characters on each side in which gazetteer and context labelers look.
REACH = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.A-Za-z-])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{2,}(?:[\x20-][0-9]{2,})*(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[a-zäöüßéèêçàáíóúñ]+")
#: What the pattern labeler proposes beside the base rules, by kind.
_PROPOSED = (
    ("secret", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,})(?![A-Za-z0-9_-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("local_phone", _LOCAL_PHONE),
)
_CAPITALISED = r"[A-ZÄÖÜÉÈÇÁÍÓÚÑ][a-zäöüßéèêçàáíóúñ]{1,30}"
#: What the context labeler proposes: a value after a word for it and a sign, and a name after words that introduce one.
_SAID = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd|wort|phrase)|pwd|secret|token|api[_ -]?key|auth[_ -]?key|access[_ -]?key|kennwort|contrase(?:ñ|n)a|clave|mot de passe)[\"']?\s*[:=]\s*[\"']?([^\s\"',;<>]{8,})")
_INTRODUCED = re.compile(rf"(?:[Mm]y name is|[Mm]ein [Nn]ame ist|[Ii]ch hei(?:ß|ss)e|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?)\s+({_CAPITALISED}(?:\s+{_CAPITALISED}){{0,2}})")

# Words that speak for a kind near it, by kind.
GAZETTEER = {
    "email": ("contact", "correo", "courriel", "email", "kontakt", "mail", "mailto", "write"),
    "ip": ("address", "adresse", "client", "dirección", "host", "ip", "peer", "server", "serveur", "servidor"),
    "card": ("card", "carte", "credit", "karte", "kreditkarte", "mastercard", "tarjeta", "visa"),
    "phone": ("call", "cell", "fax", "handy", "mobile", "móvil", "phone", "tel", "telefon", "telephone", "teléfono", "téléphone"),
    "secret": ("api", "apikey", "auth", "bearer", "clave", "contraseña", "key", "kennwort", "passe", "passwd", "password", "passwort", "pwd", "secret", "token"),
    "local_phone": ("call", "cell", "fax", "handy", "mobile", "móvil", "phone", "tel", "telefon", "telephone", "teléfono", "téléphone"),
    "iban": ("account", "bank", "banque", "bic", "compte", "cuenta", "iban", "konto", "swift"),
    "national_id": ("id", "number", "security", "social", "ssn"),
    "person": ("herr", "frau", "name", "nombre", "llamo", "signed", "sincerely"),
}
# Given names; the gazetteer labeler proposes them before another capitalised word.
GIVEN_NAMES = (
    "Alejandro", "Andrew", "Anthony", "Barbara", "Carlos", "Catherine", "Charles", "Christopher", "Daniel", "David", "Elizabeth", "Emily", "Fernando", "Francesca", "Friedrich", "Gabriel", "George", "Hannah",
    "Heinrich", "Isabella", "James", "Jennifer", "Jessica", "Johannes", "Jonathan", "Joseph", "Katharina", "Kenneth", "Margaret", "Matthew", "Michael", "Nicholas", "Patricia", "Pierre", "Rebecca", "Richard",
    "Robert", "Samantha", "Sebastian", "Stephanie", "Susanne", "Thomas", "Victoria", "William", "Wolfgang", "Yolanda",
)
# Words that speak against personal data near a number.
AGAINST = frozenset(("article", "build", "chapter", "checksum", "commit", "doi", "figure", "isbn", "issn", "page", "price", "release", "section", "sha", "table", "version", "volume"))
#: A pattern alone proposes nothing right after one of them.
_AGAINST = re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(sorted(AGAINST))})[0-9]*[\s:#=]*\Z")
_FOR = {k: frozenset(v) for k, v in GAZETTEER.items()}
_NAMED = re.compile(rf"\b(?:{'|'.join(GIVEN_NAMES)})\s+{_CAPITALISED}")
#: Texts without any of these hold nothing that the context labeler proposes, as a secret (lower case) and as a name.
_SAYS = ("pass", "pwd", "secret", "token", "key", "kennwort", "contrase", "clave", "mot de")
_INTRODUCES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra", "name is", "name ist", "ich hei", "m'appelle", "me llamo", "nombre es", "Ich hei", "Me llamo", "M'appelle")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that the base rules give, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def proposed(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, labeler) of what labelers propose beside the base rules: pattern, context or gazetteer."""
    out = []
    if _DIGIT.search(text) or "PRIVATE KEY" in text:
        out += [(kind, *m.span(), "pattern") for kind, pattern in _PROPOSED for m in pattern.finditer(text)]
    lowered = text.lower()
    if any(x in lowered for x in _SAYS):
        out += [("secret", *m.span(1), "context") for m in _SAID.finditer(text)]
    if any(x in text for x in _INTRODUCES):
        out += [("person", *m.span(1), "context") for m in _INTRODUCED.finditer(text)]
    if any(x in text for x in GIVEN_NAMES):
        out += [("person", *m.span(), "gazetteer") for m in _NAMED.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, by base rules, what is known of it) of base and other spans. Proposals that overlap a base span, or one that begins before or is longer, go, as do a pattern's right after a word against it.

    What is known are the labelers' votes (+, 0 or -) and, after a colon, features of the span.
    """
    base = base_spans(text)
    out = [(kind, a, b, True, _votes(text, kind, a, b, frozenset()) + ":" + _shape(text, a, b)) for kind, a, b in base]
    by: dict[tuple[int, int, str], set[str]] = {}
    for kind, a, b, labeler in proposed(text):
        by.setdefault((a, b, kind), set()).add(labeler)
    if not by:
        return out
    taken = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    end = 0
    for a, b, kind in sorted(by, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if by[a, b, kind] == {"pattern"} and _AGAINST.search(text[max(0, a - 16) : a]):
            continue
        before = bisect.bisect_left(begins, b)  # base spans that begin before this one ends
        if a < end or before and reach[before - 1] > a:
            continue
        end = b
        out.append((kind, a, b, False, _votes(text, kind, a, b, frozenset(by[a, b, kind])) + ":" + _shape(text, a, b)))
    return out


def _votes(text: str, kind: str, start: int, end: int, by: frozenset[str]) -> str:
    span = text[start:end]
    before, after = text[max(0, start - REACH) : start].lower(), text[end : end + REACH].lower()
    near = set(_WORDS.findall(before)) | set(_WORDS.findall(after))
    digits = _digits(span)
    pattern = "+" if "pattern" in by or kind in BASE else "0"
    context = "+" if "context" in by else "-" if near & AGAINST else "0"
    gazetteer = "+" if "gazetteer" in by or near & _FOR[kind] else "0"
    check, shape = "0", "0"
    if kind == "secret":
        check = "+" if len(digits) >= 4 and len(set(span)) >= 10 else "0" if by != {"pattern"} else "-"
        shape = "+" if re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9]{20,}|(?:sk|pk|rk|gh.|xox.|eyJ)[-_A-Za-z0-9.]*|-----BEGIN(?s:.*)", span) and not span.isdigit() else "0"
    elif kind == "local_phone":
        check = "+" if 9 <= len(digits) <= 12 else "-"
        shape = "-" if re.search(r"[0-9][-/ ]?$", before) or re.match(r"[-/ ]?[0-9]", after) else "0"
    elif kind == "iban":
        bare = span.replace(" ", "")
        check = "+" if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else "-"
        shape = "+" if 15 <= len(bare) <= 34 else "-"
    elif kind == "national_id":
        check = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
    elif kind == "person":
        check = "+" if " " in span else "0"
        shape = "+" if all(3 <= len(w) <= 12 for w in span.split()) else "-"
    else:
        check = "+"
        shape = "-" if kind == "ip" and (re.search(r"[0-9.]$", before) or re.match(r"\.?[0-9]", after)) else "+" if len(set(digits)) >= 4 or kind == "email" else "0"
    return pattern + check + gazetteer + context + shape


def _shape(text: str, start: int, end: int) -> str:
    """Features of a span in a few letters: length, share of digits, share of distinct characters, cases, quotes around, begin of a line."""
    span = text[start:end]
    size = len(span)
    length = "abcdef"[min(5, max(0, size.bit_length() - 2))]
    share = lambda n: "abcd"[min(3, 4 * n // max(1, size))]
    cases = "abcd"[2 * any(c.isupper() for c in span) + any(c.islower() for c in span)]
    quoted = "ab"[start > 0 and text[start - 1] in "\"'`=:" or text[end : end + 1] in tuple("\"'`")]
    return length + share(len(_digits(span))) + share(len(set(span))) + cases + quoted + "ab"[start == 0 or text[start - 1] == "\n"]


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """(prior by kind, reliability by labeler) by expectation-maximisation over (kind, votes, count).

    A labeler that votes is right with its reliability, whatever the span; labelers are independent given the truth.
    """
    kinds = sorted({k for k, _, _ in patterns})
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v.partition(":")[0]] for _, v, _ in patterns]).reshape(-1, len(LABELERS))
    counts = np.array([n for _, _, n in patterns], float)
    of = np.array([kinds.index(k) for k, _, _ in patterns])
    prior, reliable = np.full(len(kinds), 0.5), np.full(len(LABELERS), 0.8)
    for _ in range(rounds if len(counts) else 0):
        odds = np.log(prior / (1 - prior))[of] + votes @ np.log(reliable / (1 - reliable))
        p = 1 / (1 + np.exp(-odds))
        # two pseudo-votes each keep estimates off 0 and 1
        prior = np.array([(1 + (counts * p)[of == k].sum()) / (2 + counts[of == k].sum()) for k in range(len(kinds))])
        right = counts @ ((votes > 0) * p[:, None] + (votes < 0) * (1 - p[:, None]))
        reliable = np.clip((right + 1.6) / (counts @ (votes != 0) + 2), 0.55, 0.99)
        prior = np.clip(prior, 0.02, 0.98)
    return dict(zip(kinds, prior.tolist())), reliable


_LETTERS = ("abcdef", "abcd", "abcd", "abcd", "ab", "ab")


def _features(kind: str, known: str) -> np.ndarray:
    votes, _, shape = known.partition(":")
    return np.array([1.0, *[kind == k for k in KINDS], *[v == s for v in votes for s in "+-"], *[c == x for c, letters in zip(shape, _LETTERS) for x in letters[1:]]], float)


def train(patterns: list[tuple[str, str, int]], rounds: int = 400) -> np.ndarray:
    """Weights of the span classifier: logistic regression on kind, votes and the span's own features, to the labels that estimate() gives."""
    weights = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + sum(len(x) - 1 for x in _LETTERS))
    if not patterns:
        return weights
    prior, reliable = estimate(patterns)
    x = np.array([_features(k, v) for k, v, _ in patterns])
    signed = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v.partition(":")[0]] for _, v, _ in patterns])
    p = np.array([prior[k] for k, _, _ in patterns])
    target = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + signed @ np.log(reliable / (1 - reliable)))))
    share = np.array([n for _, _, n in patterns], float)
    share /= share.sum()
    for _ in range(rounds):  # Newton's method, slightly damped
        now = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (share * (now - target)) + 1e-4 * weights
        curve = (x * (share * now * (1 - now))[:, None]).T @ x + 1e-4 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def probability(weights: np.ndarray, kind: str, votes: str) -> float:
    return float(1 / (1 + np.exp(-_features(kind, votes) @ weights)))


_SPAN = "struct<kind: string, start: bigint, end: bigint, base: boolean, votes: string>"
_SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            t = text.as_py() or ""
            rows.append([dict(zip(("kind", "start", "end", "base", "votes"), x)) for x in candidates(t)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(_SPAN_ARROW))], names=["id", "found"])


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Spans of personal data in each document.

    Labelers propose spans and vote: patterns, checks (Luhn, check sums, ranges, numbers of digits), a gazetteer of names and of words
    near, context (a value after a word for it, a name after what introduces one; words against), and shape. Their votes over all
    documents are counted by kind, votes and the span's own features, of which there are at most some ten thousand patterns in
    practice; from these counts expectation-maximisation estimates each labeler's reliability, and the labels so found train a
    logistic span classifier on votes and features. Base spans always stay; others are added at a probability of threshold or
    more, where they overlap no base span and no proposal that begins before.

    Returns one row per input row: id, spans (array of kind, start, end, base, probability; by kind as in KINDS, then start;
    code points, end exclusive). Null and empty texts have no spans, repeated rows have theirs each, ids of any type go along, an empty
    table gives no rows. Other columns are ignored. Lowers the session's limits on Arrow batches (bound_batches).
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = materialize(rows.mapInArrow(_label, f"id {kind}, found array<{_SPAN}>"), "pii")
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r.kind, r.votes, r.n) for r in counted)
    weights = train(patterns)
    known = F.create_map(*[F.lit(v) for k, v, _ in patterns for v in (f"{k}{v}", probability(weights, k, v))]) if patterns else F.create_map(F.lit(""), F.lit(0.0))
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    scored = F.transform("found", lambda x: F.struct(rank[x["kind"]].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), known[F.concat(x["kind"], x["votes"])].alias("probability")))
    kept = F.filter(F.sort_array(scored), lambda x: x["base"] | (x["probability"] >= threshold))
    return found.select(F.col("id").alias(id_col), F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["probability"].alias("probability"))).alias("spans"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_added (spans beside the base ones), n_spans (all) and found (whether there is any)."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    n_spans, n_base = F.size("spans").cast("long"), F.size(base).cast("long")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (n_spans - n_base).alias("n_added"), n_spans.alias("n_spans"), (n_spans > 0).alias("found"),
    )
