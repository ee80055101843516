"""Frame bindings and end-to-end presets built from the operators."""
