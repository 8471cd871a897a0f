"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels the white-space separated tokens of a text: O, or the beginning or inside of an email, ip, card, phone
or secret, so that neighbours of one kind are told apart. It is trained on a small table of labelled sentences (made from
templates, see labelled_table), with the shapes of a token and its neighbours as features, and decoded by Viterbi over
padded numpy batches. Its spans are added where they overlap no base span; the base spans always stay. Numbers of cards
must pass their checksum and addresses have parts of at most 255, as in the base; what the field adds are spans that the
base patterns miss: secrets, names outside of ASCII, other separators, and items inside a longer match that fails.

Tokens without a digit, "@", "(at)" or quote are plain. Where a plain token's neighbours are plain too, O leads every label by
more than all transitions could make up for (checked after training), so the best labelling has O there, and a chain
may be cut there without a change: only stretches around other tokens are decoded.

Defined results: null texts are empty and have no spans; offsets count code points, end exclusive; repeated rows are
treated alike; an empty table gives no rows; clashing input columns are not carried over.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracework.session import whole_texts

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O", *[f"{part}-{kind}" for kind in KINDS for part in "BI"]]

# fixed values: the base patterns; possessive where backtracking couldn't change the match
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@\"]|\(at\)")
_TOKEN = re.compile(r"\S+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: for each "@" the run of name characters before it, from the last match's end on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by kind, then start."""
    if not _MARKED.search(text):
        return []
    out = emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def shape(token: str) -> str:
    """Character classes with runs folded: short runs of digits keep their length up to 4, longer ones its power of two."""
    out = []
    for run in re.finditer(r"[0-9]+|[A-Z]+|[a-z]+|[^\W\d_]+|.", token, re.DOTALL):
        s = run.group()
        kind = "d" if s[0] in "0123456789" else "X" if s.isupper() else "x" if s.isalpha() else s[0]
        n = len(s)
        part = f"d{n if n <= 4 else 'p' + str(n.bit_length())}" if kind == "d" else kind
        if not out or out[-1] != part:
            out.append(part)
    return "".join(out)


#: Marks that stand around a token without being part of it.
_AROUND = ".,;:!?|#*$%&"
_SEPARATED = re.compile(r"[0-9]+(?:[./_-][0-9]+)*")


def features(token: str) -> list[str]:
    """Features of one token by itself."""
    bare = token.strip(_AROUND)
    core = bare.strip("\"'")
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    hexa = len(core) >= 16 and all(c in "0123456789abcdefABCDEF" for c in core)
    kind = "hex" if hexa and digits < len(core) else "digits" if core and digits == len(core) else "at" if "@" in core or "(at)" in core else "mixed" if digits else "plain"
    return [
        f"k={kind}", f"k={kind} n={min(len(core), 40).bit_length()}", f"s={shape(core)}", f"d={min(digits, 20)}", f"dots={min(core.count('.'), 4)}",
        f"first={core[:1] if not core[:1].isalnum() else ''}", f"quoted={bare[:1] in '\"' and bare != core}", f"long={len(core) >= 16} {digits >= 4} {letters >= 4}",
    ]


def number_runs(tokens: list[str]) -> dict[int, str]:
    """Token -> its part in a number that passes the cards' checksum: one (a token of 13 to 19 digits), first or more (of
    groups as they are printed on cards)."""
    bare = [t.strip(_AROUND).strip("\"'") for t in tokens]
    out: dict[int, str] = {}
    for i, t in enumerate(bare):
        if i in out or not _SEPARATED.fullmatch(t):
            continue
        digits = re.sub("[^0-9]", "", t)
        if 13 <= len(digits) <= 19:
            if luhn(digits):
                out[i] = "one"
            continue
        for sizes in ((4, 4, 4, 4), (4, 6, 5)):
            group = bare[i : i + len(sizes)]
            if tuple(map(len, group)) == sizes and all(g.isascii() and g.isdigit() for g in group) and luhn("".join(group)):
                out |= {i: "first"} | {i + k: "more" for k in range(1, len(sizes))}
                break
    return out


def is_plain(token: str) -> bool:
    return not _MARKED.search(token)


_PLAIN = ["k=plain"]


def token_features(tokens: list[str], at: int, runs: dict[int, str]) -> list[str]:
    own = _PLAIN if is_plain(tokens[at]) else [*features(tokens[at]), f"run={runs.get(at, '')}"]
    out = list(own)
    for d in (-1, 1):
        if 0 <= at + d < len(tokens):
            near = tokens[at + d]
            out += [f"{d}:plain"] if is_plain(near) else [f"{d}:{f}" for f in features(near)[::2][:2]]
            if near in ("=", ":") or near.lower() in ("token", "key", "secret"):
                out.append(f"{d}:{near.lower()}")
        else:
            out.append(f"{d}:edge")
    return out


def labelled_table(n: int = 360, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Labelled sentences of invented words, with personal data and with numbers that are none."""
    rng = random.Random(seed)
    parts = ["ba", "ki", "lo", "mer", "tan", "su", "ver", "o", "ne", "qui", "ñá", "ö"]
    some = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    word = lambda: some() + rng.choice(["", "", "", ".", ",", "!!", "%%%"])
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def number(k: int, valid: bool) -> str:
        while luhn(found := digits(k)) != valid:
            pass
        return found

    def labelled(kind: str, *tokens: str) -> list[tuple[str, str]]:
        return [(t, f"{'I' if i else 'B'}-{kind}") for i, t in enumerate(tokens)]

    def grouped(text: str) -> list[str]:
        return [text[i : i + 4] for i in range(0, 16, 4)]

    def item() -> list[tuple[str, str]]:
        kind = rng.choice(["email", "ip", "card", "cards", "dotted", "failed", "groups", "phone", "phones", "local", "secret", "secrets", "key", "year", "count", "price", "version", "quote", "date", "book", "inside"])
        end = rng.choice(["", "", "", ".", ",", "!!", "$$$", "###"])
        if kind == "email":
            at = rng.choice(["@", "@", "@", "(at)"])
            return labelled("email", f"{some()}{rng.choice(['', '.'])}{digits(2)}{at}{some()}{rng.randint(0, 9)}.{rng.choice(['example', 'mail'])}.com" + end)
        if kind == "ip":
            return labelled("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4)) + end)
        if kind == "card":
            return labelled("card", number(rng.choice([13, 15, 16, 16, 16, 19]), True) + end)
        if kind == "cards":
            return _closed(labelled("card", *grouped(number(16, True))), end)
        if kind == "dotted":
            return labelled("card", rng.choice([".", "-", "/", "_"]).join(grouped(number(16, True))) + end)
        if kind == "inside":  # a short number right before a card
            return [(digits(rng.randint(1, 3)), "O"), *_closed(labelled("card", *grouped(number(16, True))), end)]
        if kind == "failed":
            return [(number(rng.choice([13, 14, 15, 16, 16, 16, 17, 18, 19]), False) + end, "O")]
        if kind == "groups":
            return _closed([(g, "O") for g in grouped(number(16, False))], end)
        if kind == "phone":
            return _closed(labelled("phone", f"+{rng.randint(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"), end)
        if kind == "phones":
            return labelled("phone", f"+{rng.randint(1, 99)}{digits(9)}{end}")
        if kind == "local":
            return _closed(labelled("phone", f"({digits(3)})", f"{digits(3)}-{digits(4)}"), end) if rng.random() < 0.6 else labelled("phone", f"{digits(3)}-{digits(3)}-{digits(4)}{end}")
        hexes = "".join(rng.choices(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), k=rng.choice([32, 40, 40, 40, 64])))
        if kind == "secret":
            said = rng.choice(["token", "key", "secret", "TOKEN", "Token"])
            return [(said, "O"), ("=", "O"), *labelled("secret", f'"{hexes}"{end}')]
        if kind == "secrets":
            return labelled("secret", hexes + end)
        if kind == "key":
            return labelled("secret", "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=16)) + digits(8) + end)
        plain = {
            "year": str(rng.randint(1000, 2100)), "count": digits(rng.randint(1, 9)).lstrip("0") or "0", "price": f"{rng.randint(1, 999)}.{digits(2)}",
            "version": f"{rng.choice(['v', ''])}{rng.randint(0, 9)}.{rng.randint(0, 20)}", "quote": f'"{word()}"', "date": f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            "book": f"978-{rng.randint(0, 9)}-{digits(2)}-{digits(6)}-{rng.randint(0, 9)}",
        }
        return [(plain[kind] + end, "O")]

    out = []
    for _ in range(n):
        sentence = []
        for _ in range(rng.randint(1, 4)):
            sentence += [(word(), "O") for _ in range(rng.randint(0, 5))] + (item() if rng.random() < 0.85 else [])
        out.append(sentence or [(word(), "O")])
    return out


def _closed(tokens: list[tuple[str, str]], end: str) -> list[tuple[str, str]]:
    return [*tokens[:-1], (tokens[-1][0] + end, tokens[-1][1])]


@dataclass
class Field:
    """names: feature -> row of emissions (features x labels); transitions (from x to)."""

    names: dict[str, int]
    emissions: np.ndarray
    transitions: np.ndarray

    def scores(self, tokens: list[str]) -> np.ndarray:
        out, runs = np.zeros((len(tokens), len(LABELS))), number_runs(tokens)
        for i in range(len(tokens)):
            for f in token_features(tokens, i, runs):
                row = self.names.get(f)
                if row is not None:
                    out[i] += self.emissions[row]
        return out

    def plain_margin(self) -> float:
        """How far O leads on a plain token between plain ones, beyond what transitions could make up for."""
        rows = [self.names[f] for f in ("k=plain", "-1:plain", "1:plain") if f in self.names]
        score = self.emissions[rows].sum(0)
        reach = self.transitions.max() - self.transitions.min()
        return float(score[0] - score[1:].max() - 2 * reach)


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, seqs))
    out, mask = np.zeros((len(seqs), longest, len(LABELS))), np.zeros((len(seqs), longest), bool)
    for i, s in enumerate(seqs):
        out[i, : len(s)], mask[i, : len(s)] = s, True
    return out, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[list[tuple[str, str]]] | None = None, rounds: int = 100, penalty: float = 0.02, rate: float = 0.2) -> Field:
    """Maximum penalised likelihood by Adam; all sentences in each round, padded."""
    table = table or labelled_table()
    said = [[t for t, _ in s] for s in table]
    lists = [[token_features(tokens, i, runs) for i in range(len(tokens))] for tokens, runs in ((t, number_runs(t)) for t in said)]
    names = {f: i for i, f in enumerate(sorted({f for s in lists for fs in s for f in fs}))}
    n, m, longest = len(table), len(LABELS), max(map(len, table))
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    hot = np.zeros((n * longest, len(names)), np.float32)
    for i, s in enumerate(table):
        for t, (_, label) in enumerate(s):
            gold[i, t], mask[i, t] = LABELS.index(label), True
            hot[i * longest + t, [names[f] for f in lists[i][t]]] = 1
    target = np.eye(m)[gold] * mask[:, :, None]
    steps = np.einsum("nta,ntb->ab", target[:, :-1], target[:, 1:])
    params = [np.zeros((len(names), m)), np.zeros((m, m))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        emit = (hot @ params[0]).reshape(n, longest, m)
        trans = params[1]
        alpha, beta = np.zeros((n, longest, m)), np.zeros((n, longest, m))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            moved = _lse(alpha[:, t - 1, :, None] + trans[None], 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = _lse(trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], back, 0)
        total = _lse(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        pair = np.zeros((m, m))
        for t in range(1, longest):
            joint = alpha[:, t - 1, :, None] + trans[None] + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            pair += (np.exp(np.minimum(joint, 0)) * mask[:, t, None, None]).sum(0)
        grads = [hot.T @ (single - target).reshape(n * longest, m), pair - steps]
        for p, (a, b), g in zip(params, moments, grads, strict=True):
            g = g / n + penalty / n * p
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field(names, *params)


def viterbi(field: Field, seqs: list[np.ndarray], cells: int = 200_000) -> list[np.ndarray]:
    """Best label numbers of each sequence of emission scores; batches of similar lengths, a bounded number of cells."""
    order, out, at = sorted(range(len(seqs)), key=lambda i: len(seqs[i])), [np.zeros(0, int)] * len(seqs), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(seqs[order[end]]) <= cells:
            end += 1
        own = order[at:end]
        at = end
        emit, mask = _padded([seqs[i] for i in own])
        n, longest, m = emit.shape
        best, back = emit[:, 0], np.zeros((n, longest, m), np.int8)
        for t in range(1, longest):
            via = best[:, :, None] + field.transitions[None]
            back[:, t] = np.where(mask[:, t, None], via.argmax(1), np.arange(m)[None])
            best = np.where(mask[:, t, None], via.max(1) + emit[:, t], best)
        label = best.argmax(1)
        path = np.zeros((n, longest), int)
        for t in range(longest - 1, -1, -1):
            path[:, t] = label
            label = back[np.arange(n), t, label]
        for row, i in enumerate(own):
            out[i] = path[row, : len(seqs[i])]
    return out


#: Plain tokens on either side of a stretch.
REACH = 3


def stretches(tokens: list[str], reach: int = REACH) -> list[tuple[int, int]]:
    """Token ranges around the tokens that aren't plain, with `reach` plain ones on either side."""
    out: list[list[int]] = []
    for i, token in enumerate(tokens):
        if not is_plain(token):
            a, b = max(0, i - reach), min(len(tokens), i + reach + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def _confirmed(kind: str, text: str) -> bool:
    """The checks of the base hold for what the field adds too."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p.lstrip("0")[:4] or 0) <= 255 for p in parts)
    return kind != "phone" or 7 <= len(digits) <= 15


def _items(path: list[int]) -> list[tuple[str, int, int]]:
    """(kind, first token, end) of a path's items: each beginning starts one, and so does an inside that goes on nothing."""
    out: list[list] = []
    for i, label in enumerate(LABELS[p] for p in path):
        if label == "O":
            continue
        part, kind = label.split("-")
        if part == "I" and out and out[-1][0] == kind and out[-1][2] == i:
            out[-1][2] = i + 1
        else:
            out.append([kind, i, i + 1])
    return [tuple(x) for x in out]


def added_spans(field: Field, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """The field's spans that overlap no base span, for each text."""
    jobs, seqs = [], []
    for n, text in enumerate(texts):
        if not _MARKED.search(text):
            continue
        matches = list(_TOKEN.finditer(text))
        tokens = [m.group() for m in matches]
        for a, b in stretches(tokens) if field.plain_margin() > 0 else [(0, len(tokens))]:
            low = max(0, a - REACH)
            seqs.append(field.scores(tokens[low : b + REACH])[a - low :][: b - a])
            jobs.append((n, matches[a:b]))
    out: list[list[Span]] = [[] for _ in texts]
    for (n, matches), path in zip(jobs, viterbi(field, seqs), strict=True):
        for kind, i, j in _items(path.tolist()):
            text, begin, end = texts[n], matches[i].start(), matches[j - 1].end()
            while begin < end and not (text[begin].isalnum() or text[begin] in "+("):
                begin += 1
            while end > begin and not text[end - 1].isalnum():
                end -= 1
            if begin < end and _confirmed(kind, text[begin:end]) and all(end <= a or b <= begin for _, a, b in bases[n]):
                out[n].append((kind, begin, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256, spans of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, bases)
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in KINDS[:4]]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
            spans = [joined(b + a) for b, a in zip(bases, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return whole_texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
