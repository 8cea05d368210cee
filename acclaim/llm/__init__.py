"""Training-data operators: packing, fingerprints, decontamination, token counts, near-duplicates,
language-model scores, licence lookup, chat formatting, token files and language identification."""
