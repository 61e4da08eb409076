"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from citeforge.llm import bitplanes, brown, bytecnn, containment, fertility, interaction, markov, merkle, oddsketch, packing, skipchain, tagpaths, warc

QUERIES = {
    "op1_fertility": fertility.op1_fertility,
    "op2_skip_chain": skipchain.op2_skip_chain,
    "op3_brown": brown.op3_brown,
    "op4_capture_index": warc.op4_capture_index,
    "op5_bit_planes": bitplanes.op5_bit_planes,
    "op6_containment": containment.op6_containment,
    "op7_odd_sketches": oddsketch.op7_odd_sketches,
    "op8_markov": markov.op8_markov,
    "op9_packing": packing.op9_packing,
    "op10_byte_cnn": bytecnn.op10_byte_cnn,
    "op11_interaction": interaction.op11_interaction,
    "op12_tag_paths": tagpaths.op12_tag_paths,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {"op4_capture_index": warc.ORACLE, "op6_containment": containment.ORACLE, "op11_interaction": interaction.ORACLE, "op13_merkle": merkle.ORACLE}
