import pytest

from waymark.llm import bpe


@pytest.fixture(scope="session")
def vocabulary():
    return bpe.public_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents: (doc_id, text) pairs, or with lang and source, and columns whose names the operators use too."""

    def make(rows, extra=False):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if extra:
            for c in ("node", "n", "key", "part", "chunk", "row", "a", "b", "component", "v", "c0", "h", "tail", "lang_pred", "score", "epoch", "block", "n_tokens", "kept", "c"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
