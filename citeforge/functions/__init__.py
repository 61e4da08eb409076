"""Part of citeforge; see the package README."""
