"""Queries and oracle SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from gridlore.llm.divergence import OP12_SQL, op12_source_divergence
from gridlore.llm.licenses import OP3_SQL, op3_license_digests
from gridlore.llm.media import op5_png_media
from gridlore.llm.mixing import OP2_SQL, op2_pareto_mix
from gridlore.llm.near_vectors import op13_sign_hash_dedup
from gridlore.llm.ngram_join import op4_ngram_join
from gridlore.llm.packing import op6_pack_tiers
from gridlore.llm.passages import op8_passage_dedup
from gridlore.llm.quality import op10_subword_quality
from gridlore.llm.rules import OP7_SQL, op7_rule_ledger
from gridlore.llm.search import OP11_SQL, op11_wand_search
from gridlore.llm.sharding import op1_label_shards
from gridlore.llm.toxicity import op9_ordinal_toxicity

QUERIES = {
    "op1_label_shards": op1_label_shards,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_license_digests": op3_license_digests,
    "op4_ngram_join": op4_ngram_join,
    "op5_png_media": op5_png_media,
    "op6_pack_tiers": op6_pack_tiers,
    "op7_rule_ledger": op7_rule_ledger,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_ordinal_toxicity": op9_ordinal_toxicity,
    "op10_subword_quality": op10_subword_quality,
    "op11_wand_search": op11_wand_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_sign_hash_dedup": op13_sign_hash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pareto_mix": OP2_SQL,
    "op3_license_digests": OP3_SQL,
    "op7_rule_ledger": OP7_SQL,
    "op11_wand_search": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
