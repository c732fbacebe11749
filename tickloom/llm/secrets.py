"""Secrets in documents: fixed forms, and random strings told by their tokens.

A vocabulary of byte pairs learned from text has long tokens for what people write and short
ones for the rest. A run of letters, digits and ``+/_=-`` with few characters a token was
therefore drawn at random. Digests, identifiers and names made of words look alike or come
close, so they are left out before.
"""

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import PATTERN, VOCABULARY

# Forms of secrets, by kind, with the shortest match that counts (of group 2
# where there is one). Matches are found first and measured then.
FORMS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: A run matches whole, so the shortest length can stand in the pattern of these two.
QUICK = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}
KINDS = (*[f[0] for f in FORMS], "random")

#: Runs that are tested, and the characters a token below which a run is random.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.0
#: Longer runs are tested in pieces of this size, so that a hidden key isn't averaged away.
PIECE = 256
# Lengths of common digests in hex and base32, and how some are marked.
DIGESTS = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                     r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
                     r"|[A-Z2-7]{32}|sha(?:256|384|512)-[A-Za-z0-9+/]+=*)")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, "
          "spans array<struct<kind:string,start:long,end:long,ratio:double>>")


def forms(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each form's leftmost matches that don't overlap
    and are long enough, in code points."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(FORMS):
        for m in QUICK.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def named(run: str) -> bool:
    """A digest, a UUID, a number or ruler, or a name whose parts are words or numbers: in
    names a single letter stands alone only seldom, in random strings all the time."""
    if DIGESTS.fullmatch(run) or UUID.fullmatch(run):
        return True
    parts = PART.findall(run)
    letters = [p for p in parts if not p[0].isdigit()]
    if not letters:
        return True
    single = sum(len(p) == 1 for p in letters)
    return single * 8 <= len(letters) and sum(map(len, letters)) >= 3 * len(letters)


def random_runs(text: str, taken: list[tuple[int, int, int]], n_tokens, ratio: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, characters a token) of runs below the ratio that no form has found."""
    at, covered = 0, sorted((s, e) for s, _, e in taken)
    reach = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        # forms that begin before this run ends
        while at < len(covered) and covered[at][0] < end:
            reach = max(reach, covered[at][1])
            at += 1
        if reach > start or named(m.group()):
            continue
        # pieces of one size, the last ones sharing what is left
        n = -(-(end - start) // PIECE)
        cuts = [start + (end - start) * i // n for i in range(n + 1)]
        open_from, chars, tokens = None, 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = text[a:b]
            used = n_tokens(piece)
            if (b - a) < ratio * used and not named(piece):
                open_from = a if open_from is None else open_from
                chars, tokens = chars + b - a, tokens + used
            elif open_from is not None:
                yield open_from, a, chars / tokens
                open_from, chars, tokens = None, 0, 0
        if open_from is not None:
            yield open_from, end, chars / tokens


def find_secrets(docs: DataFrame, ratio: float = RATIO, vocabulary: str = VOCABULARY,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, and spans (kind, start, end, ratio) by
    start and then kind as listed in ``KINDS``; places count code points, the end is exclusive.
    ``ratio`` of a span is its characters a token, null for the fixed forms.

    Whole texts are read; null and empty ones have no spans. Repeated rows are scanned each;
    further columns are not read. The vocabulary is read on the driver and sent to the executors."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})

        def n_tokens(piece: str) -> int:
            return len(encoder.encode_ordinary(piece))

        for batch in batches:
            counts, spans = [[], [], []], []
            for value in batch.column("text"):
                whole = value.as_py() or ""
                base = forms(whole)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                more = [(s, len(FORMS), e, r) for s, e, r in random_runs(whole, base, n_tokens, ratio)]
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "ratio": r}
                              for s, k, e, r in sorted([(*x, None) for x in base] + more, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(spans, pa.list_(span))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "spans"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, SCHEMA))
