"""Plain versions of the operators, a document at a time, to hold results against."""

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


def fertility(text, pieces, pairs):
    words = WORD.findall(text or "")
    ids = [i for w in words for i in pieces.encode(w)]
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0
    chars = sum(map(len, words))
    return n, chars / n, chars / sum(len(pairs.encode_ordinary(" " + w)) for w in words), sum(map(pieces.IsByte, ids)) / n, -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())


def keeps(text, pieces, pairs, rules):
    n, _, _, _, repeated = counts(text)
    if n < rules.least_words or 100 * repeated > rules.most_repeated * n:
        return False
    band = rules.bands["latin"]
    tokens, cpt, cpp, fallback, entropy = fertility(text, pieces, pairs)
    return band.chars_per_token[0] <= cpt <= band.chars_per_token[1] and band.chars_per_pair[0] <= cpp <= band.chars_per_pair[1] and fallback <= band.fallback_share and entropy >= band.entropy_ratio * min(10.0, math.log2(max(2, tokens)))


def without_repeats(docs):
    """docs: {id: text}, taken in the order of ids."""
    first, out = {}, {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        solid = [p for p, line in enumerate(lines) if WORD.search(line)]
        covered = set()
        for w in range(len(solid) - 2):
            own = solid[w : w + 3]
            if first.setdefault(tuple(lines[p] for p in own), (i, w)) != (i, w):
                covered.update(own)
        out[i] = "\n".join(line for p, line in enumerate(lines) if p not in covered)
    return out


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """{node: least node reachable}."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[a] != root[b] and linked(a, b):
                    low = min(root[a], root[b])
                    changed |= root[a] != low or root[b] != low
                    root[a] = root[b] = low
    return root


def mixed(docs, p, shares):
    """docs: [(id, source, tokens)]; [(id, epoch, block)] by one running sum a source and pass."""
    sources = sorted({s for _, s, _ in docs})
    out = []
    for share, s in zip(shares([sum(t for _, x, t in docs if x == s) for s in sources], p), sources, strict=True):
        own = [(i, t) for i, x, t in docs if x == s]
        total = sum(t for _, t in own)
        for epoch in range(share.passes + (share.rest > 0)):
            at = 0
            for i, t in sorted(own, key=lambda d: (hashlib.md5(f"{p.seed}:{epoch}:{d[0]}".encode()).hexdigest(), d[0])):
                if epoch < share.passes or at < share.rest:
                    out.append((i, epoch, (epoch * total + at) // share.width))
                at += t
    return sorted(out)


def article(page, words):
    """Main text of a well-formed page, told line by line; ``words`` holds the fixed lists of names."""
    import xml.etree.ElementTree as ET

    lines, marks, regions, tags = [], [], [0], [0]
    buffer, linked = [], [0]

    def end(state):
        text = " ".join("".join(buffer).split())
        if text:
            lines.append({"text": text, "linked": linked[0], "tags": tags[0], **state})
            tags[0] = 0
        buffer.clear()
        linked[0] = 0

    def mark(el, in_main):
        if el.tag in ("html", "body"):
            return None
        if el.tag in words.APART and not (el.tag == "header" and in_main):
            return {"weight": 0.02, "readers": False, "named": True}
        hint = False
        for key in ("class", "id", "role"):
            for name in el.get(key, "").split():
                parts = set(re.split(r"[-_]", name))
                if parts & words.LAYOUT:
                    continue
                if parts & words.MARKS:
                    return {"weight": 0.02, "readers": bool(parts & words.READERS), "named": False}
                hint = hint or bool(parts & words.HINTS)
        return {"weight": 0.1, "readers": False, "named": False} if hint and not in_main and el.tag not in words.HEADINGS else None

    def add(text, state):
        if text and not state["dropped"]:
            buffer.append(text)
            linked[0] += len(text) * state["link"]

    def walk(el, state):
        tags[0] += 1
        block = el.tag in words.BLOCKS
        if block:
            end(state)
        own = dict(state)
        if el.tag in words.DROPPED:
            own["dropped"] = True
        if not own["dropped"]:
            found = mark(el, state["main"])
            if found:
                marks.append(found | {"holds": False})
                own["marks"] = (*state["marks"], len(marks) - 1)
            elif el.tag in words.MAIN or el.tag == "h1":
                for m in own["marks"]:
                    marks[m]["holds"] = True
        if el.tag in words.CONTAINERS and not state["main"]:
            regions[0] += 1
            own["region"] = regions[0]
            own["main"] = el.tag in words.MAIN and not own["dropped"] and not any(marks[m]["readers"] for m in own["marks"])
        own["link"] = state["link"] or el.tag == "a"
        add(el.text, own)
        for child in el:
            walk(child, own)
            add(child.tail, own)
        tags[0] += 1
        if block:
            end(own)

    walk(ET.fromstring(page), {"dropped": False, "marks": (), "main": False, "region": 0, "link": False})
    plain = lambda x: max(0, len(x["text"]) - x["linked"])
    whole = sum(map(plain, lines))
    for i, m in enumerate(marks):
        held = [x for x in lines if i in x["marks"]]
        chars = sum(map(plain, held))
        most = len(held) >= 3 and chars > (0.95 * whole if m["readers"] else whole / 2)
        m["void"] = not m["named"] and (most or (m["holds"] and not m["readers"] and 2 * chars > whole))
    for x in lines:
        force = [i for i in x["marks"] if not marks[i]["void"]]
        x["group"] = force[0] if force else None
        x["main"] = x["main"] and not force
        x["ratio"] = plain(x) / max(1, x["tags"]) * math.prod(marks[i]["weight"] for i in force) * (2 if x["main"] else 1)
    for x in lines:
        same = [y for y in lines if y["group"] == x["group"]]
        at = next(i for i, y in enumerate(same) if y is x)
        weights = [(math.exp(-((i - at) ** 2) / 4.5) if abs(i - at) <= 3 else 0) for i in range(len(same))]
        x["level"] = sum(w * y["ratio"] for w, y in zip(weights, same, strict=True)) / sum(weights)
    levels = sorted(x["level"] for x in lines)
    if not levels:
        return ""
    spread = lambda v: sum((a - sum(v) / len(v)) ** 2 for a in v)
    border = levels[0]
    if levels[-1] - levels[0] >= 1e-9:
        cut = min(range(1, len(levels)), key=lambda i: spread(levels[:i]) + spread(levels[i:]))
        border = (levels[cut - 1] + levels[cut]) / 2
    size = lambda xs: sum(len(x["text"]) for x in xs)
    has_article = 2 * size([x for x in lines if x["main"]]) >= size(lines)
    key = lambda x: ("mark", x["group"]) if x["group"] is not None else ("region", x["region"])
    groups = collections.defaultdict(list)
    for x in lines:
        groups[key(x)].append(x)
    mean = {k: sum(x["level"] * len(x["text"]) for x in xs) / size(xs) for k, xs in groups.items()}
    kept = set()
    for k, xs in groups.items():
        few = sum(min(x["linked"], len(x["text"])) for x in xs) / size(xs) < 1 / 3
        if mean[k] >= border or (k[0] == "region" and few and (any(x["main"] for x in xs) or not has_article)):
            kept.add(k)
    bare = {k for k in groups if k[0] == "region"}
    if len(groups) > 1 and max(mean.values()) <= 0:
        kept &= bare
    elif not bare and all(marks[k[1]]["named"] or sum(k[1] in x["marks"] for x in lines) < 3 for k in groups):
        kept = set()
    return "\n".join(x["text"] for x in lines if key(x) in kept)


MASK = (1 << 64) - 1


def span_hash(raw):
    import numpy as np

    from simvane.llm import text as tx

    return int(tx.SpanHash(np.frombuffer(raw, np.uint8))(np.array([0]), np.array([len(raw)]))[0])


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def quality_score(text, model, bits):
    """A classifier's score, n-gram by n-gram."""
    step = 0xD6E8FEB86659FD93
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^\x20\x09-\x0d]", (text or "").encode())
    shapes = []
    for i, t in enumerate(tokens):
        if not re.match(rb"[A-Za-z0-9\x80-\xff]", t):
            shape = 100 + t[0]
        elif i and tokens[i - 1] == t:
            shape = 6
        elif re.search(rb"[a-z]", t):
            shape = 3 if t[:1].isupper() else 4
        elif len(re.findall(rb"[A-Z]", t)) > 1:
            shape = 2
        else:
            shape = 1 if t[:1].isdigit() else 5
        shapes.append(shape)
    hashes = [span_hash(t) for t in tokens]
    keys = set(hashes)
    keys |= {mix((a * step + b) & MASK) for a, b in zip(hashes, hashes[1:])}
    two = [mix((a * step + b) & MASK) for a, b in zip(shapes, shapes[1:])]
    three = [mix((a * step + b) & MASK) for a, b in zip(two, shapes[2:])]
    for kind, found in ((1, [mix(s) for s in shapes]), (2, two), (3, three)):
        keys |= {mix(k + kind & MASK) for k in found}
    buckets = {k >> (64 - bits) for k in keys}
    if not buckets:
        return model.prior
    norm = math.sqrt(sum(model.ratio[b] ** 2 for b in buckets)) or 1.0
    margin = sum(model.ratio[b] * model.weights[b] for b in buckets) / norm + model.bias
    return 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.shift))))


def toxicity_score(text, model, p):
    """A text's mean of word vectors, word by word and n-gram by n-gram."""
    words = collections.Counter(re.findall(rb"[A-Za-z0-9\x80-\xff@$*']+", (text or "").lower().encode()))
    if not words:
        return model.prior
    total = sum(math.log1p(n) for n in words.values()) + p.blank
    logit = model.bias
    for word, n in words.items():
        letters = word.decode()
        keys = [span_hash(word) + 1]
        for k in range(p.grams[0], p.grams[1] + 1):
            for i in range(len(letters) - k + 1):
                ends = (i == 0) + 2 * (i + k == len(letters))
                keys.append(span_hash(letters[i : i + k].encode()) + ends * 0x2545F4914F6CDD1D)
        gains = [model.gain[mix(key & MASK) >> (64 - p.bits)] for key in keys]
        logit += math.log1p(n) / total * sum(gains) / len(gains)
    return float(model.curve(logit))


class Languages:
    """Word-first backoff over strings: learns from (text, lang) rows."""

    def __init__(self, rows, p):
        self.p, self.langs = p, sorted({s for _, s in rows})
        found = collections.defaultdict(collections.Counter)  # (n, string) -> language -> occurrences
        for text, lang in rows:
            for word in self.words(text):
                found[0, word][lang] += 1
                for n in range(1, p.longest + 1):
                    for i in range(len(word) - n + 1):
                        found[n, word[i : i + n]][lang] += 1
        enough = {k: collections.Counter({s: n for s, n in c.items() if n >= p.least_count}) for k, c in found.items()}
        known = {k: c for k, c in enough.items() if c}
        totals = {n: {s: sum(c[s] + p.smoothing for k, c in known.items() if k[0] == n) for s in self.langs} for n in range(p.longest + 1)}
        self.logs = {k: [math.log((c[s] + p.smoothing) / totals[k[0]][s]) for s in self.langs] for k, c in known.items()}
        self.floor = [math.log(p.smoothing / totals[1][s]) if totals[1][s] else 0.0 for s in self.langs]

    @staticmethod
    def words(text):
        return [w.decode() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode())]

    def word(self, word):
        if (0, word) in self.logs:
            return self.logs[0, word]
        n = min(self.p.longest, len(word))
        open_, parts = set(range(len(word) - n + 1)), []
        while n:
            parts += [self.logs[n, word[i : i + n]] for i in sorted(open_) if (n, word[i : i + n]) in self.logs]
            open_ = {j for i in open_ if (n, word[i : i + n]) not in self.logs for j in ((i, i + 1) if n > 1 else (i,))}
            n -= 1
        parts += [self.floor] * len(open_)
        return [sum(x) / len(parts) for x in zip(*parts, strict=True)]

    def predict(self, text):
        words = self.words(text)
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        mean = [sum(x) / len(words) for x in zip(*map(self.word, words), strict=True)]
        z = [math.exp((m - max(mean)) * min(len(words), self.p.evidence)) for m in mean]
        best = max(range(len(z)), key=lambda i: (z[i], -i))
        return self.langs[best], z[best] / sum(z)
