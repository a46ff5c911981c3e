import re
from collections import Counter
from hashlib import sha256
from itertools import accumulate
from pathlib import Path

import pytest

from tableops.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = Path(P.path("byte_bpe_50k.json")).read_text(), Path(P.path("piece_bpe_32k.model")).read_bytes()


def plain(docs):
    """The contract on whole texts, with the tokens' decoded bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second, letters = Tokenizer.from_str(A), sentencepiece.SentencePieceProcessor(model_proto=B), alignment.byte_letters()
    first.encode_special_tokens = True
    made, counts = [], Counter()
    for key, text in docs:
        groups = []
        if text:
            data = (" " + text).encode()
            a = first.encode(" " + text, add_special_tokens=False)
            b = second.encode(text)
            a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
            if b"".join(a_bytes) == data and b"".join(b_bytes) == data:
                ends = [{end: i + 1 for i, end in enumerate(accumulate(map(len, t)))} for t in (a_bytes, b_bytes)]
                last = (0, 0)
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    at = (ends[0][end], ends[1][end])
                    groups.append((a.ids[last[0] : at[0]], b[last[1] : at[1]]))
                    last = at
        counts.update((x[-1], y[-1]) for x, y in groups)
        made.append((key, groups))
    top = {b: max(n for (_, y), n in counts.items() if y == b) for b in {y for _, y in counts}}
    out = []
    for key, groups in made:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups)]
        out.append((key, *sizes, sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha256(digest.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TEXTS = [
    "A plain sentence, with a mark or two. And a plain one!",
    "héllo 日本語 \U0001f600\U0001f600 ภาษา كتاب ☃️ \U00012000́",
    "two  spaces, a tab\there,\n\na blank line \n and an odd space  end ",
    " starts with a space",
    "<|endoftext|> <s> </s> <unk> <0x41> are plain text",
    "holds ▁ itself",
    "it's we'll 12,345.678 x=y_z; http://a.b/c?d=e  #tag",
    "\x1c\x1d odd \x00 separators\r\nand ﻿ marks ​",
    "longword" * 3000,
    " ",
    "\n",
    "a",
    "",
    None,
]


def ours(spark, docs, **options):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, pair string, uid int")
    return sorted((tuple(r) for r in alignment.aligned(df, A, B, **options).collect()), key=repr)


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_equals_whole_texts(spark, most_sent):
    docs = [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[1]), (3, "A plain word")]
    assert ours(spark, docs, most_sent=most_sent) == plain(docs)


def test_forgets_and_learns_again(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    docs = [(i, f"number {i} of {i % 7} words, {'again' * (i % 5)}") for i in range(60)]
    assert ours(spark, docs) == plain(docs)


@pytest.mark.parametrize("most_sent", [10, 0])
def test_empty_table(spark, most_sent):
    assert ours(spark, [], most_sent=most_sent) == []


def test_texts_are_cut_only_where_both_cut():
    own = alignment.Aligner(A, B)
    assert not own.whole
    assert own.chunks("a b  c d\n e ") == ["a", "b  c", "d\n e "]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, docs) == plain(docs)
