"""Plain loops that the operators are held against, and small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, copies int"


def words(text):
    return [word for word in re.split(r"[\x20\x09-\x0D]+", text or "") if word]


def odd_documents(seed=7):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    pick = random.Random(seed)
    vocabulary = ["the", "of", "and", "in", "Is", "ocean", "river,", "Höhe", "is", "to", "stone.", "x@y.org", "漢字", "token=abcdefgh1"]
    texts = [" ".join(pick.choices(vocabulary, k=pick.randint(1, 90))) for _ in range(30)]
    texts += [texts[3], texts[3], texts[4] + " end", texts[5].replace("ocean", "lake", 1), None, "", " \n\t", "one", "é" * 50]
    texts += [" ".join(pick.choices(vocabulary, k=6000)), "same words again and here " * 60]
    rows = [
        (k, text, [None, "en", "de"][k % 3], [None, "a", "b", "c", "d"][k % 5], len(text or ""), f"i{k}", k, k)
        for k, text in enumerate(texts)
    ]
    rows.append(rows[2])
    return rows


def digest(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(part) <= 255 for part in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and _luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
SECRETS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""",
        lambda s: True,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda s: len(s) >= 16),
    "hex": (r"[0-9a-f]+", lambda s: len(s) >= 32),
}


def _luhn(text):
    digits = [int(c) for c in re.sub("[^0-9]", "", text)][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def base_spans(text, kinds):
    found = []
    for place, (kind, (pattern, fits)) in enumerate(kinds.items()):
        for match in re.finditer(pattern, text or ""):
            value = match.groupdict().get("value")
            if fits(match[0]) and (value is None or len(value) >= 8):
                found.append((match.start(), place, match.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def quality(text):
    sequence = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(sequence[k : k + 8]) for k in range(len(sequence) - 7)]
    times = Counter(windows)
    repeated = {k + j for k, window in enumerate(windows) if times[window] > 1 for j in range(8)}
    failed = len(sequence) < 20 or 100 * len(repeated) > 30 * len(sequence)
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(sequence), sum(map(len, sequence)), signs, len(lines) - len(set(lines)), len(repeated), failed


def fingerprint(text):
    sequence = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not sequence:
        return 0
    shingles = [" ".join(sequence[k : k + 4]) for k in range(max(1, len(sequence) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(fingerprints, radius=4):
    """Of each (id, fingerprint): the smallest id that links reach."""
    group = list(range(len(fingerprints)))
    for a in range(len(group)):
        for b in range(a):
            if (fingerprints[a][1] ^ fingerprints[b][1]).bit_count() <= radius and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    least = {g: min(fingerprints[k][0] for k in range(len(group)) if group[k] == g) for g in set(group)}
    return [least[g] for g in group]


def mixed(rows):
    """{id: (size, source size, target, taken)} of rows (id, text, source) with different ids."""
    sizes = {k: len(words(text)) for k, text, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(sizes[k] for k, _, own in rows if own == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, free, target = sum(total.values()), set(sources), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= 3 * total[s]]
        for s in full:
            target[s] = float(3 * total[s])
            left -= 3 * total[s]
            free.discard(s)
        if not full:
            target |= {s: weight[s] * left / sum(weight[q] for q in free) for s in free}
            break
    offers = []
    for s in sources:
        upto = 0
        for place, k in sorted((sha(f"mix:{k}")[:15], k) for k, _, own in rows if own == s):
            upto += sizes[k]
            offers += [((upto + n * total[s]) / target[s], place, k, n) for n in range(3) if sizes[k]]
    used, taken = 0, Counter()
    for _, _, k, _ in sorted(offers):
        used += sizes[k]
        if used > sum(sizes.values()):
            break
        taken[k] += sizes[k]
    return {k: (sizes[k], total[s], target[s], taken[k]) for k, _, s in rows}


def without_repeats(rows, span=100):
    """{row number: (bytes, removed, runs, hash of the rest)} of rows (id, text) in order."""
    seen, out = set(), {}
    for number, (_, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - span + 1):
            if data[at : at + span] in seen:
                gone[at : at + span] = b"\1" * span
            seen.add(data[at : at + span])
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        rest = bytes(c for c, off in zip(data, gone) if not off)
        out[number] = (len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def shingles(text, size=5):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    sequence = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered)
    return {tuple(sequence[k : k + size]) for k in range(len(sequence) - size + 1)}


def contained(documents, items, threshold=0.8):
    """{(document, item, shingles, shared)}."""
    out = set()
    for item, text in items:
        wanted = shingles(text)
        for document, own in documents:
            shared = len(wanted & shingles(own))
            if wanted and shared >= threshold * len(wanted) - 1e-9:
                out.add((document, item, len(wanted), shared))
    return out
