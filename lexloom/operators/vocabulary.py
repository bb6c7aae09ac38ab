"""Vocabularies: tokens with ids from 1, and the roles of special tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles whose tokens decoding leaves out.
SKIPPED_ROLES = ("pad", "cls", "sep", "bos", "eos")
_FIRST_SPELLINGS = {"pad": "[PAD]", "cls": "[CLS]", "sep": "[SEP]", "mask": "[MASK]", "bos": "<s>", "eos": "</s>"}
_OTHER_SPELLINGS = {"pad": ("<PAD>", "<pad>"), "mask": ("<mask>", "<MASK>"), "bos": ("[BOS]",), "eos": ("[EOS]",)}
UNKNOWN_SPELLINGS = ("<unk>", "<UNK>", "[UNK]")


@dataclass(frozen=True)
class Vocabulary:
    """tokens[k] has the id k + 1; specials gives the id of each role."""

    tokens: tuple[str, ...]
    ids: dict[str, int] = field(repr=False)
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, tokens, specials: dict[str, str] | None = None) -> Vocabulary:
        """From tokens in the order of their ids; roles of tokens that aren't there are left out."""
        ids: dict[str, int] = {}
        for k, token in enumerate(tokens, 1):
            if ids.setdefault(token, k) != k:
                raise ValueError(f"token {token!r} occurs twice in the vocabulary")
        return cls(tuple(tokens), ids, {role: ids[t] for role, t in (specials or {}).items() if t in ids})

    def __len__(self) -> int:
        return len(self.tokens)

    def id_of(self, token: str) -> int:
        """The token's id, or that of the unknown token."""
        found = self.ids.get(token)
        return self.unknown_id if found is None else found

    def token_of(self, ident: int) -> str:
        if not 1 <= ident <= len(self.tokens):
            raise IndexError(f"id {ident} is outside 1..{len(self.tokens)}")
        return self.tokens[ident - 1]

    @property
    def unknown_id(self) -> int:
        if "unk" not in self.specials:
            raise KeyError("the vocabulary has no unknown token")
        return self.specials["unk"]

    @property
    def skipped(self) -> frozenset[int]:
        return frozenset(self.specials[r] for r in SKIPPED_ROLES if r in self.specials)

    def frame(self, spark: SparkSession, scores=None) -> DataFrame:
        """token_id, token, logprob, special."""
        role = {i: r for r, i in sorted(self.specials.items(), reverse=True)}
        rows = [(k, t, None if scores is None else float(scores[k - 1]), role.get(k)) for k, t in enumerate(self.tokens, 1)]
        return spark.createDataFrame(rows, "token_id bigint, token string, logprob double, special string")


def special_roles(tokens, unknown: str) -> dict[str, str]:
    """Roles by the usual spellings; a role's first spelling wins."""
    there = set(tokens)
    found = {"unk": unknown} if unknown in there else {}
    found |= {role: t for role, t in _FIRST_SPELLINGS.items() if t in there}
    for role, spellings in _OTHER_SPELLINGS.items():
        for t in spellings:
            if t in there:
                found.setdefault(role, t)
    return found


def resolve_unknown(tokens, wanted: str) -> str:
    there = set(tokens)
    return next((t for t in (wanted, *UNKNOWN_SPELLINGS) if t in there), wanted)


def vocabulary_frame(tokens: DataFrame, order: str, token: str = "token") -> DataFrame:
    """token_id, token of a table of tokens in the order of a column; a token that occurs twice is an error."""
    from pyspark.sql import Window

    twice = tokens.groupBy(token).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"token {twice[0][token]!r} occurs twice in the vocabulary")
    return tokens.select(F.row_number().over(Window.orderBy(order)).cast("bigint").alias("token_id"), F.col(token).alias("token"))


def lookup_ids(pieces: DataFrame, vocabulary: DataFrame, token: str = "token", unknown_id: int | None = None) -> DataFrame:
    """``pieces`` with the token_id of each token, of unknown ones ``unknown_id``; Catalyst broadcasts the vocabulary if it is small."""
    side = vocabulary.select(F.col("token").alias("_token"), "token_id")
    found = pieces.join(side, pieces[token] == F.col("_token"), "left").drop("_token")
    return found if unknown_id is None else found.withColumn("token_id", F.coalesce("token_id", F.lit(unknown_id).cast("bigint")))


def lookup_tokens(ids: DataFrame, vocabulary: DataFrame, token_id: str = "token_id") -> DataFrame:
    """``ids`` with the token of each id; an id outside the vocabulary has none."""
    side = vocabulary.select(F.col("token_id").alias("_id"), "token")
    return ids.join(side, ids[token_id] == F.col("_id"), "left").drop("_id")


def special_mask(ids: Column, specials: dict[str, int]) -> Column:
    """1 for each id that has a role (the unknown token's too), else 0."""
    values = F.array(*[F.lit(i) for i in sorted(set(specials.values()))])
    return F.transform(ids, lambda x: F.array_contains(values, x).cast("int"))


def without_skipped(ids: Column, specials: dict[str, int]) -> Column:
    """The ids that decoding reads."""
    values = sorted({specials[r] for r in SKIPPED_ROLES if r in specials})
    return F.filter(ids, lambda x: ~x.isin(values)) if values else ids
