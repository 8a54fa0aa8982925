"""The deep-dive reports (D1.1 ... D8.1), one function each."""
