from helixframe.plans.cli import main

main()
