"""Where signals come from and results go to."""
