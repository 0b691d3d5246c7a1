"""inkledger: document-fidelity analytics as Spark DataFrame operators."""
