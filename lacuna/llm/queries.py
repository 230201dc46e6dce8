"""The queries of this subpackage and, where SQL can express one, its SQL."""

from lacuna.llm import line_spread, mixing, url_model
from lacuna.llm.conversations import op13_conversation_repair
from lacuna.llm.latent import op2_latent_leaks
from lacuna.llm.lattice import op9_lattice_neighbours
from lacuna.llm.licenses import op5_license_cosine
from lacuna.llm.line_spread import op10_line_spread
from lacuna.llm.mixing import op12_target_mix
from lacuna.llm.ngram_join import op7_ngram_jaccard
from lacuna.llm.packing import op3_genetic_packing
from lacuna.llm.periodic import op11_periodic_runs
from lacuna.llm.pii import op1_boosted_pii
from lacuna.llm.subword import op4_subword_quality
from lacuna.llm.toxicity import op6_toxicity
from lacuna.llm.url_model import op8_url_ratio

QUERIES = {
    "op1_boosted_pii": op1_boosted_pii,
    "op2_latent_leaks": op2_latent_leaks,
    "op3_genetic_packing": op3_genetic_packing,
    "op4_subword_quality": op4_subword_quality,
    "op5_license_cosine": op5_license_cosine,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_ratio": op8_url_ratio,
    "op9_lattice_neighbours": op9_lattice_neighbours,
    "op10_line_spread": op10_line_spread,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_target_mix": op12_target_mix,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op8_url_ratio": url_model.ORACLE,
    "op10_line_spread": line_spread.ORACLE,
    "op12_target_mix": mixing.ORACLE,
}
