"""See the README for what each subpackage holds."""
