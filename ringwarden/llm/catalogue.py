"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from ringwarden.llm.additive_quantisation import op8_additive_quantisation
from ringwarden.llm.decontaminate import ORACLE_OP1, op1_decontaminate
from ringwarden.llm.jaccard_join import ORACLE_OP7, op7_ngram_jaccard_join
from ringwarden.llm.language_id import op6_language_id
from ringwarden.llm.log_bilinear import op10_lm_score
from ringwarden.llm.mixing import op3_mix_domains
from ringwarden.llm.prefix_trie import ORACLE_OP13, op13_prefix_trie
from ringwarden.llm.quality_knn import op4_quality_knn
from ringwarden.llm.ranked_search import ORACLE_OP12, op12_ranked_search
from ringwarden.llm.revisits import ORACLE_OP9, op9_resolve_revisits
from ringwarden.llm.secrets import op11_secret_scan
from ringwarden.llm.sharding import op2_balanced_shards
from ringwarden.llm.substring_dedup import ORACLE_OP5, op5_substring_dedup

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_balanced_shards": op2_balanced_shards,
    "op3_mix_domains": op3_mix_domains,
    "op4_quality_knn": op4_quality_knn,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_additive_quantisation": op8_additive_quantisation,
    "op9_resolve_revisits": op9_resolve_revisits,
    "op10_lm_score": op10_lm_score,
    "op11_secret_scan": op11_secret_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_decontaminate": ORACLE_OP1,
    "op5_substring_dedup": ORACLE_OP5,
    "op7_ngram_jaccard_join": ORACLE_OP7,
    "op9_resolve_revisits": ORACLE_OP9,
    "op12_ranked_search": ORACLE_OP12,
    "op13_prefix_trie": ORACLE_OP13,
}
