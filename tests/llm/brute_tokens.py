"""Plain versions of the tokenizer and conversation operators, for small fixtures."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P


def sha(data):
    return hashlib.sha256(data).hexdigest()


def rank_file():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def tiktoken_rows(rows):
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), by the tiktoken library."""
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_file(), special_tokens={})
    out = []
    for d, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(enc.decode_bytes(ids))))
    return out


def _byte_of():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def alignment(rows):
    """(doc_id, text) -> contract rows of the alignment, all pairs written out, whole texts at once."""
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = _byte_of()

    def tokens(text):
        if not text:
            return None
        a = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, second.id_to_piece(i)) for i in second.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        data = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else None

    docs = []
    for d, text in rows:
        found, groups = tokens(text), []
        if found:
            ends = []
            for side in found:
                at, got = 0, []
                for i, x in side:
                    at += len(x)
                    got.append((at, i))
                ends.append(got)
            common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
            low = 0
            for e in common:
                groups.append(tuple([i for at, i in side if low < at <= e] for side in ends))
                low = e
        links = [(x, y) for a, b in groups for x in a for y in b]
        docs.append((d, groups, links))
    count = Counter(p for _, _, links in docs for p in set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(text.encode()) if text else ""))
    return out


def trie(turns):
    """(conv_id, turn, role, text) -> contract rows of the trie; turns of equal number must be equal."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    below = defaultdict(lambda: [0, 0])
    children = Counter(p[:-1] for p in members if p)
    for p in members:
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += saved
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *below[p],
                    sha(",".join(map(str, ends[p])).encode())) for p, m in members.items()), key=repr)
