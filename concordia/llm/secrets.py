"""Secret scans: pattern rules plus sliding-window Shannon entropy with an allow-list.

A span is (kind, start, end) in code points, end exclusive.  Base kinds are ``assign``,
``access`` and ``hex``; the entropy pass adds ``entropy_hex`` and ``entropy_mixed`` over whole candidates, and
``entropy_lower``, ``entropy_upper`` (with digits) and ``entropy_letters`` (both cases, no digit) over parts between
separators.  Letters of one case without a digit get no window: entropy does not tell them from words.

Defined results: a null text is an empty text (no spans); an empty table gives an empty table;
repeated rows each get their own row; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import ship, tidy

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper", "entropy_letters")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Window length and least entropy in bits per character class; no window is longer than the shortest candidate.
CLASSES = {"entropy_hex": (20, 3.0), "entropy_lower": (20, 3.5), "entropy_upper": (20, 3.5), "entropy_mixed": (20, 3.7), "entropy_letters": (20, 3.7)}
#: Parts of candidates that look random but are public by construction.
ALLOWED = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"  # UUID
    r"|(?<![0-9a-f])(?:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855|da39a3ee5e6b4b0d3255bfef95601890afd80709"
    r"|d41d8cd98f00b204e9800998ecf8427e)(?![0-9a-f])"  # digests of nothing
)
#: A part between separators that holds one of these is a placeholder; its neighbours are not.
PLACEHOLDER = re.compile(r"EXAMPLE|example|placeholder|PLACEHOLDER|xxxx|XXXX|0123456789|123456789|abcdefgh|ABCDEFGH")
PART = re.compile(r"[^/=_+-]+")


def entropy_regions(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged regions of *s* covered by windows whose Shannon entropy reaches *least*.

    With counts c over a window of n characters, H = log2 n - (1/n) sum c log2 c; moving the
    window by one changes two counts, so each step costs O(1).
    """
    n = len(s)
    if n < window:
        return []
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    for ch in s[:window]:
        counts[ch] = counts.get(ch, 0) + 1
    total = sum(log[c] for c in counts.values())
    bound = (math.log2(window) - least) * window + 1e-9
    found: list[tuple[int, int]] = []
    for i in range(n - window + 1):
        if i:
            out, new = s[i - 1], s[i + window - 1]
            c = counts[out]
            total += log[c - 1] - log[c]
            counts[out] = c - 1
            c = counts.get(new, 0)
            total += log[c + 1] - log[c]
            counts[new] = c + 1
        if total <= bound:
            if found and found[-1][1] >= i:
                found[-1] = (found[-1][0], i + window)
            else:
                found.append((i, i + window))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern rules alone, each leftmost and non-overlapping within its kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if max(map(len, text.split()), default=0) >= 32:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def part_kind(s: str) -> str | None:
    """The character class of a part without separators, if a class of one alphabet fits it."""
    digit, lower, upper = (re.search(p, s) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    if lower and upper:
        return None if digit else "entropy_letters"
    if not digit or not (lower or upper):
        return None
    if re.fullmatch("[0-9a-fA-F]+", s):
        return "entropy_hex"
    return "entropy_lower" if lower else "entropy_upper"


def open_pieces(s: str) -> list[tuple[int, int]]:
    """Regions of candidate *s* left by allow-listed substrings and by parts that are placeholders."""
    closed = [m.span() for m in ALLOWED.finditer(s)]
    closed += [m.span() for m in PART.finditer(s) if PLACEHOLDER.search(m.group())]
    out, at = [], 0
    for a, b in [*sorted(closed), (len(s), len(s))]:
        if at < a:
            out.append((at, a))
        at = max(at, b)
    return out


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """Random-looking regions of candidate strings, without allow-listed ones."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        for start, end in open_pieces(m.group()):
            s, at = m.group()[start:end], m.start() + start
            own: list[tuple[str, int, int]] = []
            kind = "entropy_hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "entropy_mixed"
            if re.search("[0-9]", s) and (re.search("[A-Za-z]", s) if kind == "entropy_hex" else re.search("[a-z]", s) and re.search("[A-Z]", s)):
                own += [(kind, at + a, at + b) for a, b in entropy_regions(s, *CLASSES[kind])]
            for part in PART.finditer(s):  # one alphabet, no separators: paths and slugs are not such parts
                if (kind := part_kind(part.group())) is not None:
                    regions = [(at + part.start() + a, at + part.start() + b) for a, b in entropy_regions(part.group(), *CLASSES[kind])]
                    own += [(kind, a, b) for a, b in regions if not any(c <= a and b <= d for _, c, d in own)]
            found += own
    return found


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed in KINDS."""
    text = text or ""
    return sorted(base_spans(text) + entropy_spans(text), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """*text* with every maximal union of spans replaced by *mask*."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts per base kind, digest of the base spans, all spans."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                spans = all_spans(text)
                base = [x for x in spans if not x[0].startswith("entropy")]
                for k, name in enumerate(("assign", "access", "hex")):
                    out[k].append(sum(x[0] == name for x in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
                out[5].append(len(spans) - len(base))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x, pa.int64()) for x in out[:3]),
                    *(pa.array(x, pa.string()) for x in out[3:5]),
                    pa.array(out[5], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    return src.mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    )


def redact_secrets(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """*df* with every secret span of its text masked; all rows and columns stay.

    Where *chars_col* exists it is set to the new length of the texts that changed.
    """
    names = df.columns
    at = names.index(text_col)
    count = names.index(chars_col) if chars_col in names else None

    def rewrite(batches):
        for batch in batches:
            arrays = list(batch.columns)
            new = {}
            for i, text in enumerate(x.as_py() for x in arrays[at]):
                if text and (spans := all_spans(text)):
                    new[i] = masked(text, spans, mask)
            if new:
                changed = pa.array([i in new for i in range(len(batch))], pa.bool_())
                arrays[at] = pc.replace_with_mask(arrays[at], changed, pa.array(list(new.values()), arrays[at].type))
                if count is not None:
                    old = arrays[count].to_pylist()
                    arrays[count] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(old)], arrays[count].type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(tidy(rewrite), df.schema)


ship(__name__)
