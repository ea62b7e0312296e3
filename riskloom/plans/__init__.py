"""End-to-end work built from the operators."""
