import sentencepiece
from tokenizers import Tokenizer, models

from riskfeat.llm import token_counts as T
from riskfeat.llm.plans import tokenizer_file

TEXTS = ["", None, " ", "a  b", "the cat sat on the mat, theirs", "日本 ▁x 😀😀é\n\t", "na\u0000n", "x" * 3000, "ab " * 1000, "the cat", "the cat"]


def by_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(sp.get_piece_size())]
    vocab = [("<unk>", 0.0), *[(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(len(special)) if not special[i]]]
    tokens = Tokenizer(models.Unigram(vocab, 0, False))
    out = []
    for t in texts:
        whole = T.BLANK + t.replace(" ", T.BLANK) if t else ""
        e = tokens.encode(whole)
        out.append(sum(len(whole[a:b].encode()) if i == 0 else 1 for i, (a, b) in zip(e.ids, e.offsets, strict=True)))
    return out


def test_counts_equal_the_library(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_tokens int")
    got = T.token_counts(df, tokenizer_file("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == by_library(TEXTS)
    assert [r["n_chars"] for r in got] == [len(t or "") for t in TEXTS]
    assert T.token_counts(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0
