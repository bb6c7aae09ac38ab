"""Files of tokenizers, the registry of models and training bundles."""
