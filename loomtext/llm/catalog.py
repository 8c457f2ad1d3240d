"""The registered queries of the training-data operators: name -> (query, SQL or None)."""

from loomtext.llm import bpe, chat, embedding_dedup, katz, media, mixing, ngram_join, quality, sharding, toxicity

CATALOG = {
    "op1_toxicity": (toxicity.query, None),
    "op2_ngram_join": (ngram_join.query, ngram_join.SQL),
    "op3_chat": (chat.query, chat.SQL),
    "op4_sharding": (sharding.query, sharding.SQL),
    "op5_embedding_dedup": (embedding_dedup.query, embedding_dedup.SQL),
    "op6_bpe": (bpe.query, None),
    "op7_katz": (katz.query, katz.SQL),
    "katz_3": (katz.query_3, None),
    "op8_mixing": (mixing.query, mixing.SQL),
    "op9_quality": (quality.query, None),
    "op10_media": (media.query, None),
    "media_planted": (media.planted, media.PLANTED_SQL),
}
